"""Exact, near and line dedup against plain versions."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelake.llm.exact_dedup import exact_dedup
from tidelake.llm.line_dedup import _similar, aligned, line_dedup, line_groups, prints
from tidelake.llm.links import components
from tidelake.llm import links
from tidelake.llm import near_dedup as near
from tidelake.llm.near_dedup import counted, near_dedup, rarest


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[lowered(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan_in", [2, 32])
def test_exact_dedup_is_the_plain_version(spark, odd_docs, docs, fan_in):
    for frame in (odd_docs, docs.select("doc_id", "text").repartition(9)):
        rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
        got = sorted((tuple(r) for r in exact_dedup(frame, fan_in=fan_in).collect()), key=repr)
        assert got == plain_exact(rows)


def test_exact_dedup_of_nothing(no_docs):
    assert exact_dedup(no_docs).collect() == []


def test_exact_dedup_keeps_smallest_if_asked(spark):
    frame = spark.createDataFrame([(3, "a"), (1, "A"), (2, "b")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup(frame, largest=False).collect()} == {3: 1, 1: 1, 2: 2}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def shingles(text):
    w = words_of(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def plain_near(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def near_copies(seed=3, groups=6, copies=14, length=120):
    """Groups in which copies drift away from each other, so that hubs miss links that exist between members."""
    rng, rows, n = random.Random(seed), [], 0
    for _ in range(groups):
        base = ["w%d" % rng.randrange(5000) for _ in range(length)]
        for _ in range(copies):
            for _ in range(rng.choice([0, 1, 1, 2])):
                base = list(base)
                base[rng.randrange(length)] = "w%d" % rng.randrange(5000)
            rows.append((n, " ".join(base)))
            n += 1
    rng.shuffle(rows)
    return rows


def test_near_dedup_is_the_plain_version(spark, odd_docs, docs):
    drifting = spark.createDataFrame(near_copies(), "doc_id long, text string")
    for frame in (odd_docs, drifting, docs):
        rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
        got = near_dedup(frame).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == plain_near(rows)


def test_near_dedup_compares_few_pairs_of_a_family(spark, monkeypatch):
    """Copies of one text with one to eight words changed: most are near each other, and most of these are no links."""
    rng, rows = random.Random(4), []
    base = ["w%d" % rng.randrange(5000) for _ in range(150)]
    for i in range(300):
        own = list(base)
        for _ in range(rng.randint(1, 8)):
            own[rng.randrange(len(own))] = "w%d" % rng.randrange(5000)
        rows.append((i, " ".join(own)))
    compared, plain = [], near._confirmed

    def confirmed(pairs, sets, percent):
        compared.append(pairs.count())
        return plain(pairs, sets, percent)

    monkeypatch.setattr(near, "_confirmed", confirmed)
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == plain_near(rows)
    assert sum(compared) < 1100, compared


@pytest.mark.parametrize(("percent", "changed"), [(85, 3), (80, 4)])
def test_near_dedup_joins_few_pairs_without_their_text(spark, monkeypatch, percent, changed):
    """Texts with a few words changed each of one that is missing: all are near each other, and hardly any are links."""
    rng, rows = random.Random(9), []
    base = ["w%d" % rng.randrange(5000) for _ in range(300)]
    for i in range(200):
        own = list(base)
        for at in rng.sample(range(len(own)), changed):
            own[at] = "w%d" % rng.randrange(5000)
        rows.append((i, " ".join(own)))
    met, plain = [], links.across

    def across(*args):
        out = plain(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(links, "across", across)
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    want = plain_near(rows, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want
    assert met and sum(met) < 1000, met


def test_set_sketches_of_links_are_close(spark):
    """Sets just as far apart as a link allows, small and large, against the bound; of sets four times as far apart, those of 150 to 4000 beyond it."""
    rng = np.random.default_rng(11)
    for percent in (80, 85):
        cases = []
        for n in [*range(1, 60), 150, 400, 1000, 1800, 4000, 9000]:
            apart = 2 * n * (100 - percent) // (100 + percent)
            for gone in (apart // 2, min(n, 2 * apart)):
                all_of = rng.integers(1, 1 << 63, n + gone).astype(np.uint64)
                x, y = np.unique(all_of[:n]), np.unique(all_of[gone:])
                link = 100 * (n - gone) >= percent * (n + gone)
                bits = int(np.bitwise_count((near.set_sketch(x) ^ near.set_sketch(y)).view(np.uint64)).sum())
                assert bits <= 2 * gone
                cases.append((n, bits, link))
        frame = spark.createDataFrame(cases, "n long, bits int, link boolean")
        got = [(r.n, r.link, r.close) for r in frame.select("n", "link", (F.col("bits") <= near.most_set_bits(F.col("n"), F.col("n"), percent)).alias("close")).collect()]
        assert all(close for _, link, close in got if link)
        assert not any(close for n, link, close in got if not link and 150 <= n <= 4000)


def test_rarest_shingles_of_links_meet(spark):
    """Sets of any sizes that link share one of their rarest shingles at allowed places, in any order of shingles."""
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(40):
        base = rng.integers(1, 1 << 63, rng.integers(1, 60)).astype(np.uint64)
        for _ in range(6):
            own = np.concatenate([base[rng.random(len(base)) > 0.06], rng.integers(1, 1 << 63, rng.integers(0, 4)).astype(np.uint64)])
            if len(own):
                sets.append(np.unique(own))
    frame = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "id long, set binary")
    counts = counted(frame)
    assert sum(counts.tolist()) == sum(map(len, sets))
    for order in (counts, rng.integers(2, 60000, len(counts)).astype(np.uint16)):
        met, keyed = set(), collections.defaultdict(list)
        for r in rarest(frame, order, 85).collect():
            for i, at, size in keyed[r.key]:
                if min(size - at, r.size - r["at"]) * 185 >= 85 * (size + r.size):
                    met.add((min(i, r.id), max(i, r.id)))
            keyed[r.key].append((r.id, r["at"], r.size))
        links = set()
        for b in range(len(sets)):
            for a in range(b):
                common = len(np.intersect1d(sets[a], sets[b]))
                if 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                    links.add((a, b))
        assert len(links) > 100 and links <= met


def test_near_dedup_of_repeated_ids(spark):
    words = [" ".join("w%dx%d" % (k, i) for i in range(120)) for k in range(6)]
    rows = [(1, w) for w in words[:3]] + [(10 + k, w.replace("x7 ", "y ")) for k, w in enumerate(words)] + [(None, words[0])]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == sorted([(1, 1)] * 3 + [(10, 1), (11, 1), (12, 1), (13, 13), (14, 14), (15, 15), (0, 1)])


def test_near_dedup_of_nothing(no_docs):
    assert near_dedup(no_docs).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 180)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 101: 100, 200: 150, 180: 150}


def plain_exact_lines(rows):
    """What line dedup does where no two lines are alike without being equal."""
    first, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for k, line in enumerate((t or "").split("\n")):
            key = line.lower().strip(" \t\r\v\f")
            if key:
                first.setdefault(key, (i, k))
    for i, t in rows:
        lines = t.split("\n") if t else []
        keep = [x for k, x in enumerate(lines) if i is None or not x.strip(" \t\r\v\f") or first[x.lower().strip(" \t\r\v\f")] == (i, k)]
        out[i] = (len(lines), len(keep), "\n".join(keep))
    return out


def test_line_dedup_of_equal_lines(spark, odd_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_lines, r.n_kept, r.text) for r in line_dedup(odd_docs, percent=100).collect()}
    assert got == plain_exact_lines(rows)


def test_line_dedup_of_alike_lines(spark):
    line = " ".join("token%d" % i for i in range(120))
    alike = line.replace("token60", "tokem60")
    other = " ".join("thing%d" % i for i in range(120))
    frame = spark.createDataFrame([(1, f"{line}\n{other}"), (2, f"{alike}\n\n\t{line.upper()} \r")], "doc_id long, text string")
    got = {r.doc_id: (r.n_kept, r.text) for r in line_dedup(frame).collect()}
    assert got == {1: (2, f"{line}\n{other}"), 2: (1, "")}


def distance(a, b):
    """Plain edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar(a, b):
    return distance(a, b) <= 0.2 * max(len(a), len(b))


def edited_lines(seed=5):
    """(kind, line, edited line): one to four words changed, added or taken away, and letters in words of short lines."""
    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    for n in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 17, 19, 20, 22, 25, 30, 39, 40, 44, 60, 79, 81, 120, 200]:
        for changes in (1, 2, 3, 4):
            for kind in "cidx":
                words = [word() + ("ful" if n < 3 else "") for _ in range(n)]
                new = list(words)
                for _ in range(changes):
                    at = rng.randrange(len(new))
                    if kind == "x":
                        w = new[at]
                        p = rng.randrange(len(w))
                        new[at] = w[:p] + "z" + w[p + 1 :]
                    elif kind == "i":
                        new.insert(at, word())
                    elif kind == "d" and len(new) > 1:
                        del new[at]
                    else:
                        new[at] = word()
                a, b = " ".join(words), " ".join(new)
                if a != b and similar(a, b):
                    out.append((f"{n}{kind}{changes}", a, b))
    return out


def test_similar_is_edit_distance_of_long_lines(spark):
    """Words changed, taken away and put in, at, just below and just above the allowed distance, in long and short lines."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 9)))
    cases = []
    for n in (12, 40, 380):
        for share in (0.05, 0.24, 0.3, 0.34):
            words = [word() for _ in range(n)]
            changed = [word() if rng.random() < share else w for w in words]
            cases.append((" ".join(words), " ".join(changed)))
            cases.append((" ".join(words), " ".join(changed[1:] + [word()])))
    got = [r.s for r in spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, a string, b string").select("k", _similar("a", "b", 80).alias("s")).orderBy("k").collect()]
    want = [5 * distance(a, b) <= max(len(a), len(b)) for a, b in cases]
    assert got == want and 4 < sum(want) < len(want) - 4


def test_aligned_pieces_bound_the_edit_distance(spark):
    """Never below the distance; within the limit for nearly all lines with words put in, taken away and changed, of any length."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqé") for _ in range(rng.randint(2, 11)))
    cases = [("", ""), ("a", ""), ("same words", "same words"), ("x" * 300, "x" * 301)]
    for n in (5, 30, 90, 150):
        for share in (0.02, 0.08, 0.3):
            for _ in range(6):
                words, new = [word() for _ in range(n)], []
                for w in words:
                    kind = rng.random() / share
                    new += [w] if kind > 1 else [] if kind > 0.66 else [word()] if kind > 0.33 else [w, word()]
                cases.append((" ".join(words), " ".join(new)))
    frame = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, a string, b string")
    got = [r.d for r in frame.select("k", F.expr(aligned("a", "b")).alias("d")).orderBy("k").collect()]
    want = [distance(a, b) for a, b in cases]
    assert all(g >= w for g, w in zip(got, want, strict=True))
    links = [5 * g <= max(len(a), len(b)) for g, w, (a, b) in zip(got, want, cases, strict=True) if 5 * w <= max(len(a), len(b)) >= 150]
    assert len(links) > 30 and sum(links) >= 0.9 * len(links)


def test_line_dedup_finds_edited_lines(spark):
    cases = edited_lines()
    frame = spark.createDataFrame([(2 * k + side, c[1 + side]) for k, c in enumerate(cases) for side in (0, 1)], "doc_id long, text string")
    kept = {r.doc_id: r.n_kept for r in line_dedup(frame).collect()}
    found = [kept[2 * k + 1] == 0 for k in range(len(cases))]
    missed = [c[0] for c, f in zip(cases, found, strict=True) if not f]
    assert len(cases) > 250 and sum(found) >= 0.9 * len(cases), missed
    longer = [f for c, f in zip(cases, found, strict=True) if int(c[0][:-2]) >= 8]
    assert sum(longer) >= 0.95 * len(longer), missed
    ones = [f for c, f in zip(cases, found, strict=True) if c[0].endswith("1") and not c[0].startswith("1x")]
    assert sum(ones) >= 0.98 * len(ones)
    assert all(kept[2 * k] for k in range(len(cases)))


def test_line_groups_against_all_pairs(spark, docs):
    """Every group holds together by links, and nearly all links of all pairs lie inside groups."""
    lines = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("t"))
    lines = lines.select(F.trim(F.translate(F.lower("t"), "\t\r\v\f", "    ")).alias("t")).where("t <> ''").distinct()
    lines = lines.select("t", F.xxhash64("t").alias("id"), F.length("t").alias("n")).cache()
    a, b = lines.toDF("ta", "a", "na"), lines.toDF("tb", "b", "nb")
    links = {(r.a, r.b) for r in a.join(b, F.expr("na <= nb AND na >= nb * 0.8 AND a <> b")).where(_similar("ta", "tb", 80)).select("a", "b").collect()}
    groups = {r.id: r.component for r in line_groups(docs).collect()}
    inside = [groups.get(x, x) == groups.get(y, y) for x, y in links]
    assert len(links) > 40 and sum(inside) >= 0.95 * len(links)
    linked = {x for pair in links for x in pair}
    assert set(groups) <= linked and set(groups.values()) <= linked
    lines.unpersist()


def test_line_fingerprints_are_majorities(spark, docs):
    frame = docs.limit(60).select(F.explode(F.split("text", "\n")).alias("norm")).where("length(trim(norm)) > 0").distinct()
    frame = frame.select("norm", F.xxhash64("norm").alias("h1"), F.lit(0).alias("h2"))
    hashed = frame.select("h1", F.expr("array_distinct(transform(filter(split(norm, ' '), w -> w <> ''), w -> xxhash64(w)))").alias("w"))
    rows = prints(frame).where("k >= 3 AND length < 2000").join(hashed, "h1").collect()
    assert len(rows) > 300
    for r in rows:
        low = r.block >= 100
        k, block = (r.below, r.block - 100) if low else (r.k, r.block)
        if k < 3:
            continue  # blocks of the step below that leave a word out
        deal = block // k if k < 8 else 0
        # a signed hash is taken as unsigned where it is shifted
        votes = [h % (1 << 64) for h in r.w if ((h % (1 << 64)) >> (16 * deal) if deal else h) % k == block - deal * k]
        assert r.sim == sum(1 << i for i in range(56) if 2 * sum(v >> i & 1 for v in votes) > len(votes))


def test_line_dedup_of_nothing(no_docs):
    assert line_dedup(no_docs).collect() == []


def test_line_dedup_needs_no_python(docs):
    plan = line_dedup(docs.limit(50).select("*", F.lit(1).alias("h1")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
