"""Plain per-record models of the ordered operators, for brute-force comparison on small logs."""


def suppress(rows, opts):
    """rows: dicts with logger, level, leader_template, event_ms, source, seq, window_ms.

    Returns {(source, seq): decision dict}.
    """
    limits = {
        "FATAL": opts.error_threshold,
        "ERROR": opts.error_threshold,
        "WARN": opts.warn_threshold,
        "INFO": opts.info_threshold,
    }
    seen, out = {}, {}
    for row in sorted(rows, key=lambda r: (r["event_ms"], r["source"], r["seq"])):
        key = (row["logger"], row["level"], row["leader_template"])
        now = row["event_ms"]
        entry = seen.get(key)
        idle = entry is not None and now - entry["last"] > opts.idle_ms
        if entry is None or idle:
            entry = seen[key] = {
                "life": entry["life"] + 1 if entry else 1,
                "burst": entry["burst"] + 1 if entry else 1,
                "first": now,
                "n": 0,
                "told_ms": now,
                "told_n": 0,
            }
        elif now - entry["last"] > row["window_ms"]:
            entry.update(burst=entry["burst"] + 1, first=now, n=0, told_n=0)
        entry["last"] = now
        entry["n"] += 1
        allowed = entry["n"] <= limits.get(row["level"], opts.debug_threshold)
        report = False
        if not allowed:
            new = entry["n"] - entry["told_n"]
            late = now - entry["told_ms"] > opts.report_every_ms
            report = new > 0 and (new >= opts.show_count_after or late)
            if report:
                entry.update(told_ms=now, told_n=entry["n"])
        out[row["source"], row["seq"]] = {
            "life_no": entry["life"],
            "burst_no": entry["burst"],
            "n": entry["n"],
            "first_ms": entry["first"],
            "duration_ms": now - entry["first"],
            "allowed": allowed,
            "report": report,
        }
    return out


def assemble(lines):
    """lines: ordered text of one source; returns [(index of first line, message)]."""

    def continues(line):
        body = line.strip("".join(map(chr, range(33))))
        return line != "" and (
            body == "" or body.startswith(("at ", "Caused by:", "Suppressed:", "..."))
        )

    def opens(line):
        return "Exception" in line or ("Error" in line and ("." in line or ":" in line))

    done, held = [], None
    for i, line in enumerate(lines):
        if held is not None and (line == "" or continues(line)):
            held[1].append(line)
            continue
        if held is not None:
            done.append(held)
            held = None
        if line == "":
            continue
        if opens(line):
            held = (i, [line])
        else:
            done.append((i, [line]))
    if held is not None:
        done.append(held)
    return [(i, "\n".join(part)) for i, part in done]
