import hashlib
import random
import re

from fixtures import clashing, frame, odd_rows
from pyspark.sql import functions as F

from hushlog.llm.fill_in_middle import with_fill_in_middle, with_restored

WORD = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute(key, text):
    text = text or ""
    units = WORD.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(11)
    alphabet = ["a", "é", "😀", " ", "\n", "\t", "\x0b", "\x1c", " ", " ", "<", "P", ">", "<P>", "S", "M", "\x00", "\\1"]
    return [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(25)))) for i in range(2500)]


def test_same_as_written_out(spark):
    rows = [(i, t) for i, t in texts()] + [(r[0], r[1]) for r in odd_rows()]
    done = with_restored(with_fill_in_middle(frame(spark, rows, "doc_id long, text string")))
    assert done.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = sorted((tuple(r) for r in done.collect()), key=str)
    assert got == sorted(((i, t, *brute(i, t), t or "") for i, t in rows), key=str)
    assert {r[3] for r in got} == {"plain", "spm", "psm"}


def test_other_rates_names_and_clashes(spark):
    docs = frame(spark, texts()[:200], "key long, body string")
    docs = clashing(docs, "n", "output", "_draw0", "restored", "_DRAW_1")
    all_in = with_fill_in_middle(docs, "key", "body", seed=7, rate=100, spm=0)
    assert {r.form for r in all_in.where("body <> '' AND NOT body RLIKE '<[PSM]>'").select("form").distinct().collect()} == {"psm"}
    back = with_restored(all_in)
    assert back.where("restored <> body").count() == 0
    assert back.where("_draw0 <> 'own' OR _DRAW_1 <> 'own'").count() == 0


def test_empty_table(spark):
    docs = frame(spark, [])
    assert with_restored(with_fill_in_middle(docs)).count() == 0


def test_null_output(spark):
    rows = frame(spark, [(None, "psm"), ("<P>a<S> c<M> b", "psm"), ("x", None)], "output string, form string")
    assert [r.restored for r in with_restored(rows).orderBy(F.col("form").asc_nulls_last(), "output").collect()] == [None, "a b c", "x"]
