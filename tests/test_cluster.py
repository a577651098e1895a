import random
from functools import cache

import pytest
from pyspark.sql import functions as F

from hushlog import Options
from hushlog.operators.cluster import cluster_templates, gram_size, with_leader
from hushlog.operators.templates import keyed, template_stats, with_template


@cache
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def alike(a, b, opts):
    longer = max(len(a), len(b))
    if not longer:
        return True
    if abs(len(a) - len(b)) > longer * (100 - opts.similarity_threshold) / 100:
        return False
    if longer > 200 and opts.long_text == "length_only":
        d = abs(len(a) - len(b))
    else:
        d = distance(a, b)
    return int((longer - d) / longer * 100) >= opts.similarity_threshold


def first_come(rows, opts):
    leaders, out = {}, {}
    for logger, level, text, first in sorted(rows, key=lambda r: (r[3], r[2])):
        block = leaders.setdefault((logger, level), [])
        leader = next((x for x in block if alike(x, text, opts)), None)
        if leader is None:
            block.append(text)
        out[logger, level, text] = leader if leader is not None else text
    return out


def mutated(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        i = rng.randrange(len(text) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            text.insert(i, rng.choice("abcxyz "))
        elif text and kind == 1:
            text.pop(i % len(text))
        elif text:
            text[i % len(text)] = rng.choice("abcxyz ")
    return "".join(text)


def random_templates(seed, count):
    rng = random.Random(seed)
    rows = {}
    seeds = ["".join(rng.choices("abcdefgh ", k=n)) for n in (5, 6, 7, 8, 13, 14, 20, 28, 40)]
    seeds += ["ab" * 20, "aaaaaaa", "x" * 33]
    seeds += ["".join(rng.choices("abcdefgh ", k=n)) for n in (175, 199, 204, 230)]
    for _ in range(count):
        text = rng.choice(seeds)
        text = mutated(rng, text, rng.randrange(0, 1 + max(1, len(text) // 6)))
        rows[rng.choice([None, "l"]), "INFO", text] = rng.randrange(count // 2)
    return [(*key, first) for key, first in rows.items()]


@pytest.mark.parametrize(
    "changes, batch_size",
    [({}, 1024), ({"similarity_threshold": 70}, 20), ({"long_text": "length_only"}, 40)],
)
def test_equals_first_come_assignment(spark, changes, batch_size):
    opts = Options(**changes)
    rows = random_templates(str(changes), 160)
    stats = spark.createDataFrame(rows, "logger string, level string, template string, first_ms long")
    got = cluster_templates(stats.repartition(5), opts, batch_size).collect()
    assert len(got) == len(rows)
    expected = first_come(rows, opts)
    assert {(r.logger, r.level, r.template): r.leader_template for r in got} == expected
    assert len(set(expected.values())) < len(rows) * 0.8


def test_chain_and_long_texts(spark):
    a, b, c = "abcdefghij" * 2, "abcdefghij" + "abcdefgxyz", "abcdefgxyz" * 2
    rows = [("l", "INFO", a, 1), ("l", "INFO", b, 2), ("l", "INFO", c, 3)]
    rows += [("l", "WARN", "x" * 250, 1), ("l", "WARN", "y" * 250, 2), ("l", "WARN", "z" * 180, 3)]
    stats = spark.createDataFrame(rows, "logger string, level string, template string, first_ms long")
    by_length = Options(long_text="length_only")
    got = {r.template: r.leader_template for r in cluster_templates(stats, by_length).collect()}
    assert got == {a: a, b: a, c: c, "x" * 250: "x" * 250, "y" * 250: "x" * 250, "z" * 180: "z" * 180}
    exact = {
        r.template: r.leader_template
        for r in cluster_templates(stats).collect()
    }
    assert exact["y" * 250] == "y" * 250


def test_gram_size():
    assert [gram_size(t) for t in (50, 60, 70, 80, 85, 95, 100)] == [1, 1, 2, 2, 3, 3, 3]


def test_rows_take_their_leader(spark, monkeypatch):
    rows = [("l", "INFO", "mirror eu-west is behind by a lot", 1), (None, "INFO", "mirror eu-west is behind by a bit", 2)]
    rows += [("l", "INFO", "mirror eu-west is behind by a bit", 3), ("l", "INFO", "something else", 4)]
    df = spark.createDataFrame(rows, "logger string, level string, message string, event_ms long")
    opts = Options(similarity_threshold=80)
    leaders = cluster_templates(template_stats(with_template(df, opts)), opts)
    by_broadcast = keyed(df, opts, leaders)
    monkeypatch.setattr("hushlog.operators.cluster.BROADCAST_BYTES", -1)
    by_shuffle = with_leader(with_template(df, opts), leaders)
    for got in (by_broadcast, by_shuffle):
        assert [r.leader_template for r in got.orderBy("event_ms").collect()] == [
            rows[0][2],
            rows[1][2],
            rows[0][2],
            rows[3][2],
        ]
    assert by_broadcast.filter(F.col("window_ms") == 2000).count() == 4


def test_no_templates(spark):
    none = spark.createDataFrame([], "logger string, level string, template string, first_ms long")
    assert cluster_templates(none).count() == 0
    alone = spark.createDataFrame(
        [("l", None, "", 1)], "logger string, level string, template string, first_ms long"
    )
    assert [tuple(r) for r in cluster_templates(alone).collect()] == [("l", None, "", "")]


def test_few_rounds_where_little_is_alike(spark, monkeypatch):
    from hushlog.operators import cluster

    settled, sizes = cluster._settle_batch, []

    def counted(batch, *given):
        sizes.append(batch.count())
        return settled(batch, *given)

    monkeypatch.setattr(cluster, "_settle_batch", counted)
    monkeypatch.setattr(cluster, "FIRST_BATCH", 16)
    monkeypatch.setattr(cluster, "DENSE_BATCH", 16)
    rng = random.Random(3)
    rows = [("l", "INFO", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=30)), i) for i in range(600)]
    stats = spark.createDataFrame(rows, "logger string, level string, template string, first_ms long")
    got = cluster_templates(stats).filter("template = leader_template").count()
    assert got == len(rows) and sizes == [16, 64, 256, 264]


def test_similar_texts_share_the_grams_they_must(spark):
    rng, rows = random.Random(11), {}
    for n in [3, 6, 7, 13, 14, 20, 27, 34] * 2:
        text = "".join(rng.choices("abcd", k=n))
        for edits in range(2 + n * 15 // 100):
            rows["l", "INFO", mutated(rng, text, edits)] = len(rows)
    rows = [(*key, first) for key, first in rows.items()]
    stats = spark.createDataFrame(rows, "logger string, level string, template string, first_ms long")
    got = {(r.logger, r.level, r.template): r.leader_template for r in cluster_templates(stats).collect()}
    assert got == first_come(rows, Options())


def test_distances_are_spread_over_tasks(spark):
    from hushlog.operators import cluster

    texts = [("n", 0, 1, "abcdefghijklmnopqrst"), ("n", 1, 2, "abcdefghijklmnopqrsu")]
    nodes = spark.createDataFrame(texts, "block string, id long, first_ms long, template string")
    nodes = nodes.withColumn("len", F.char_length("template"))
    pairs = cluster._similar_by_text(nodes, nodes, cluster._gram_keys(nodes, Options()), Options())
    assert "RepartitionByExpression" in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in pairs.collect()] == [(0, 1)]


def test_a_text_is_compared_by_one_row(spark):
    rng = random.Random(5)
    syllables = ["th", "er", "on", "an", "in", "ha", "ent", "ing"]
    rows = [("l", "INFO", "".join(rng.choices(syllables, k=40)), i) for i in range(60)]
    stats = spark.createDataFrame(rows, "logger string, level string, template string, first_ms long")
    nodes = stats.select(
        F.struct("logger", "level").alias("block"),
        F.col("first_ms").alias("id"),
        "first_ms",
        "template",
        F.char_length("template").alias("len"),
    )
    from hushlog.operators import cluster

    assert cluster._gram_keys(nodes, Options()).count() == len(rows)


@pytest.mark.parametrize("changes", [{}, {"similarity_threshold": 70}, {"long_text": "length_only"}])
def test_cells_of_large_blocks(spark, monkeypatch, changes):
    from hushlog.operators import cluster

    monkeypatch.setattr(cluster, "CELL_ROWS", 5)
    opts = Options(**changes)
    rows = random_templates("cells" + str(changes), 120)
    stats = spark.createDataFrame(rows, "logger string, level string, template string, first_ms long")
    got = cluster_templates(stats.repartition(3), opts, 40).collect()
    assert {(r.logger, r.level, r.template): r.leader_template for r in got} == first_come(rows, opts)


@pytest.mark.parametrize("threshold", [50, 70, 85, 95])
def test_signatures_keep_all_within_the_distance(threshold):
    import pyarrow as pa

    from hushlog.operators import cluster

    rng, lefts, rights = random.Random(threshold), [], []
    for n in [1, 2, 3, 7, 14, 21, 40, 85, 86, 170, 171, 230, 341, 700, 1400] * 6:
        text = "".join(rng.choices("abcdé語😀 ", k=n))
        allowed = n * (100 - threshold) // 100
        lefts.append(text)
        rights.append(mutated(rng, text, rng.choice([allowed, allowed // 2])))

    def side(texts, first_id):
        bits = cluster._signatures(pa.array(texts, pa.string()), cluster.gram_size(threshold))
        ids, lens = pa.array(range(first_id, first_id + len(texts))), pa.array([len(t) for t in texts], pa.int32())
        names = ["id", "len", "template", "bits"]
        return cluster._Texts([pa.RecordBatch.from_arrays([ids, lens, pa.array(texts), bits], names)])

    found = cluster._candidates(side(lefts, 0), side(rights, 1000), threshold)
    pairs = {(a, b - 1000) for x in found for a, b in zip(x["left_id"].to_pylist(), x["right_id"].to_pylist())}
    for i, (a, b) in enumerate(zip(lefts, rights)):
        edits = abs(len(a) - len(b))
        if b and edits * 100 <= max(len(a), len(b)) * (100 - threshold):
            # the edits made may exceed what the longer text allows by a rounding
            within = len(a) * (100 - threshold) // 100 <= max(len(a), len(b)) * (100 - threshold) // 100
            assert not within or (i, i) in pairs, (a, b)
