import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strataform.llm import decontaminate, license_scan, quality_rules

DOCS = "doc_id long, text string, source string, row string, found string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def rows():
    rng = random.Random(3)
    pool = ["The", "ÉTÉ", "a", "b2", "zürich", "x-y", "of", "CC", "BY", "all rights", "reserved"]
    text = lambda n: "".join(rng.choice(pool) + rng.choice([" ", "\n", ", ", "\t "]) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([1, 2, 3, 7, 9, 10, 11, 30, 60])] + [(90, None), (91, "--"), (None, text(12)), (5, "short of it")]
    texts = [None, "", " \n ", *[text(n) for n in (1, 3, 60, 400, 3000)]] + [text(20) + i[1] + text(5) for i in items if i[1]]
    texts += ["GENERAL public-license", "This work is licensed under the GNU General Public License, version 3.\nRedistributed", "licensed under the apache license version 2", "Licensed: apache license version 2 0"]
    docs = [(k, t, f"host{k % 3}" if k % 4 else None, "clash", "clash") for k, t in enumerate(texts)]
    return docs + [docs[-1], docs[-1], (None, "x y z", "host1", "c", "c")], items


def brute_hits(text, items):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        v = words(t)
        size = min(10, len(v))
        known = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1 if v else 0):
            if tuple(w[i : i + size]) in known:
                hit |= set(range(i, i + size))
                ids.add(item)
    ids = sorted(str(i) for i in ids if i is not None)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most,broadcast", [(1 << 26, 16 << 20), (64, 0)])
def test_decontamination(spark, monkeypatch, most, broadcast):
    monkeypatch.setattr(decontaminate, "MOST_BITS", most)
    monkeypatch.setattr(decontaminate, "BROADCAST", broadcast)
    data, items = rows()
    docs, benchmark = spark.createDataFrame(data, DOCS), spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(d, *brute_hits(t, items)) for d, t, *_ in data], key=repr)
    assert sorted([tuple(r) for r in decontaminate.contamination(docs, benchmark).collect()], key=repr) == want
    kept = decontaminate.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((d for d, *_, bad in want if not bad), key=repr)
    assert decontaminate.contamination(docs, benchmark.limit(0)).filter("contaminated or n_hit > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), benchmark).count() == 0


def test_large_benchmark_is_scanned_the_same_way(spark):
    rng = random.Random(9)
    items = [(k, " ".join(f"w{rng.randrange(5000)}" for _ in range(609))) for k in range(500)]  # 300,000 windows
    data = [(k, " ".join(f"w{rng.randrange(5000)}" for _ in range(300)) + (" " + " ".join(items[k][1].split()[50:70]) if k % 5 == 0 else ""), "s", "r", "f") for k in range(200)]
    docs, benchmark = spark.createDataFrame(data, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.contamination(docs, benchmark).collect()}
    assert got == {k: (20, 1) if k % 5 == 0 else (0, 0) for k in range(200)}
    assert {r.doc_id for r in decontaminate.keep_clean(docs, benchmark).collect()} == {k for k in range(200) if k % 5}


def brute_measures(data):
    want = []
    for d, t, s, *_ in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = Counter(tri)
        rep = {j for i, x in enumerate(tri) if seen[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        want.append((d, s, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep), failed))
    return want


def brute_verdicts(data):
    """The rows that verdicts gives, and the hosts that it rejects."""
    want = brute_measures(data)
    hosts = {}
    for r in want:
        hosts.setdefault(r[1], []).append(r[-1])
    rates = [sum(v) / len(v) for v in hosts.values()]
    m = sum(rates) / len(rates)
    v = (sum((x - m) ** 2 for x in rates) / (len(rates) - 1) if len(rates) > 1 else 0) - sum(x * (1 - x) / len(f) for x, f in zip(rates, hosts.values())) / len(rates)
    k = max(1, min(1000, m * (1 - m) / v - 1)) if v > 0 else 1000
    bad = set()
    for h, f in hosts.items():
        r = (sum(f) + m * k) / (len(f) + k)
        if r - 1.96 * (r * (1 - r) / (len(f) + k + 1)) ** 0.5 > 3 * m / (1 - m + 3 * m):
            bad.add(h)
    return sorted([(r[0], *r[2:], not r[-1] and r[1] not in bad) for r in want], key=repr), bad


def test_quality_rules(spark):
    data, _ = rows()
    docs = spark.createDataFrame(data, DOCS)
    assert sorted([tuple(r) for r in quality_rules.verdicts(docs).collect()], key=repr) == brute_verdicts(data)[0]
    assert quality_rules.verdicts(docs.limit(0)).count() == 0 and quality_rules.verdicts(docs.drop("source")).count() == len(data)


def test_bad_hosts_are_rejected(spark):
    good = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    data = [(k, good(k) if k % 10 else "short", f"host{k % 12}", "r", "f") for k in range(1200)]
    data += [(5000 + k, good(k) if k % 3 == 0 else "short", "bad", "r", "f") for k in range(120)]
    data += [(6000 + k, "short", "few", "r", "f") for k in range(2)] + [(7000, "short", None, "r", "f")]
    want, bad = brute_verdicts(data)
    got = sorted([tuple(r) for r in quality_rules.verdicts(spark.createDataFrame(data, DOCS)).collect()], key=repr)
    assert got == want and bad == {"bad"} and sum(not r[-1] and not r[-2] for r in got) == 40


def test_windows_with_equal_hash_bits_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "_hash", lambda a, b, c: F.call_function("shiftleft", F.pmod(F.xxhash64(a, b, c), F.lit(5)), F.lit(40)))
    data, _ = rows()
    got = sorted([(r.doc_id, r.n_repeat_words) for r in quality_rules.measured(spark.createDataFrame(data, DOCS)).collect()], key=repr)
    assert got == sorted([(r[0], r[6]) for r in brute_measures(data)], key=repr) and any(n for _, n in got)


def test_license_scan(spark):
    data, _ = rows()
    want = []
    for d, t, *_ in data:
        w, spots, base, more, best = words(t), [], set(), set(), 0.0
        for phrase, label in license_scan.PHRASES.items():
            at = [i for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
            spots += at
            base |= {label} if at else set()
        lines, parts = (t or "").split("\n"), [[]]
        for line in lines:
            parts[-1].append(line)
            if not words(line):
                parts.append([])
        pairs = [a + "\n" + b for a, b in zip(lines, lines[1:]) if not re.search("[.!?:;][\"')\\]]*[ \t\r]*\\Z", a)]
        blocks = {license_scan.NOTICE: lines + pairs, license_scan.PASSAGE: ["\n".join(p) for p in parts]}
        for label, kind, text, telling, without in license_scan.TEMPLATES:
            tokens = set(words(text))
            for block in blocks[kind]:
                held = set(words(block))
                if 10 * len(tokens & held) >= 8 * len(tokens) and set(telling.split()) <= held and not set(without.split()) & held:
                    more.add(label)
                    best = max(best, len(tokens & held) / len(tokens))
        want.append((d, len(w), len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if spots else best))
    docs = spark.createDataFrame(data, DOCS)
    assert sorted([tuple(r) for r in license_scan.scan(docs).collect()], key=repr) == sorted(want, key=repr)
    assert license_scan.scan(docs.limit(0)).count() == 0
    assert any(w[-1] not in (0, 1) for w in want)


LABELLED = [
    ("Text.\nLicensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
    ("Licensed under CC BY-SA 4.0.\nMore", "cc-by,cc-by-sa"),
    ("Licensed under CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa"),
    ("Licensed under CC BY-NC 4.0.\nLicensed under CC BY-SA 4.0.", "cc-by,cc-by-nc,cc-by-sa"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("Licensed under the GNU Lesser General\nPublic License.", "gpl,lgpl"),
    ("Some words\nLicensed under the Apache\nLicense, Version 2.0.\nand more", "apache-2.0"),
    ("# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:\n#\n# 1. Other", "bsd"),
    (" * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n *\n * This", "gpl,gpl-3.0"),
    ("Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles (the Software), to deal in the Software without\nrestriction, including without limitation the rights to use,\ncopy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the\nSoftware is furnished to do so", "mit"),
    ("the general public may use the license, version 3, of this text", ""),
    ("All rights reserved.", "reserved"),
    ("free software", ""),
]


def test_licences_by_name(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(LABELLED)], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license_scan.scan(docs).collect()} == {k: labels for k, (_, labels) in enumerate(LABELLED)}
