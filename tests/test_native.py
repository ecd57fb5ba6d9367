"""Expressions against the plain matcher and brute force: arrays, both engines, terms, names, masking, similar hashes."""

import random
import re
import time

import plain as R
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hushframe.functions import arrays, batch
from hushframe.functions import native as N
from hushframe.functions.dialect import RUN_CLASS, first_characters, needs, to_java, to_python, to_search
from hushframe.functions.spans import places
from hushframe.operators import detect as D
from hushframe.operators import images, mask, terms
from hushframe.operators.detect import detect, detect_native, detect_rules
from hushframe.plans import queries as Q


@pytest.fixture(scope="module")
def texts(spark, sf):
    """Documents, letters and notes with something for every rule, and odd ones."""
    docs = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    customers = spark.read.parquet(f"{sf}/customer.parquet").limit(8)
    made = [r[0] for sql in (Q.LETTER, Q.NOTE) for r in customers.select(F.expr(sql)).collect()]
    odd = [None, "", "a", "a@b.cd", "﷐a@b.cd﷑ x@y.zw ﷒", "é a@b.cd 🙂 4111 1111 1111 1111", "Maria Del Rey's and Maria Del, MARIA DEL; Maria Company"]
    return docs + made + odd


def test_running_and_parts(spark):
    draw = random.Random(1)
    rows = [[draw.randrange(-5, 9) for _ in range(n)] for n in (0, 1, 2, 3, 10, 99, 100, 1000)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<int>")
    got = df.select("i", arrays.running(F.col("v")), arrays.running(F.col("v"), F.greatest)).collect()
    for i, sums, most in got:
        assert sums == [sum(rows[i][: k + 1]) for k in range(len(rows[i]))] and most == [max(0, *rows[i][: k + 1]) for k in range(len(rows[i]))]
    text = "".join(draw.choice("ab\n🙂é") for _ in range(2000))
    at = [(a, z) for a in (0, 1, 511, 512, 513, 1024, 1999, 2000) for z in (0, 1, 511, 512, 513, 1024, 1536, 2000) if a <= z]
    df = spark.createDataFrame([(text, a, z) for a, z in at], "t string, a int, z int")
    assert all(r.p == text[r.a : r.z] for r in df.select("a", "z", arrays.part(arrays.blocks(F.col("t")), F.col("a"), F.col("z")).alias("p")).collect())


def test_what_patterns_need(texts):
    """A text that lacks what a pattern needs has no match of it."""
    patterns = [(p, f, r.dotted) for r in N.built_in() for p, f in r.patterns] + [(r[-1], r[-2], r[0] in ("tech-ipv4", "tech-domain")) for r in R.V.RULES]
    for t in filter(None, texts):
        low = t.lower()
        digits, run = (max(map(len, re.findall(c, t)), default=0) for c in ("[0-9]+", RUN_CLASS + "+"))
        dotted = bool(re.search(r"[A-Za-z0-9]\.[A-Za-z0-9]", t))
        for p, f, d in patterns:
            n = needs(p, f)
            if n.digits > digits or n.run > run or n.literals and not any(x in low for x in n.literals) or d and n.literals == (".",) and not dotted:
                assert not to_python(p, f).search(t), (p, n)


def test_searched_patterns(spark, texts):
    """A pattern that leaves places at a look at one character finds what the plain one finds, and is a literal of the plan."""
    rules = [(p, f) for r in N.built_in() for p, f in r.patterns] + [(r[-1], r[-2]) for r in R.V.RULES]
    led = [(p, f) for p, f in rules if to_search(p, f) != to_java(p, f)]
    assert len(led) > 0.9 * len(rules)
    for t in filter(None, texts[-23:]):
        for p, f in led:
            assert all(m.group()[0] in first_characters(p, f) for m in to_python(p, f).finditer(t))
    df = spark.createDataFrame([(t,) for t in texts[-23:]], "t string")
    for i in range(0, len(led), 40):
        of = led[i : i + 40]
        both = df.select(*(F.regexp_extract_all("t", F.lit(f"({to(p, f)})"), F.lit(1)).alias(f"{to.__name__}{k}") for k, (p, f) in enumerate(of) for to in (to_java, to_search)))
        for r in both.collect():
            assert all(r[f"to_java{k}"] == r[f"to_search{k}"] for k in range(len(of)))
    assert first_characters(r"a*") is None and first_characters(r"\b(?:x|[yz])", "i") == set("xyzXYZ")


def test_patterns_over_a_batch(texts):
    """Arrow's matcher finds what ``re`` finds, and takes all patterns but those that look around."""
    rules = [(p, f, i % 2 == 0) for i, (p, f) in enumerate([*(x for r in N.built_in() for x in r.patterns), *((r[-1], r[-2]) for r in R.V.RULES), ("é[st]", "i"), ("a*", ""), (r"(a)|b", "")])]
    assert sum(batch.searched(p, f) is None for p, f, _ in rules) <= 6
    own = [*texts[-23:], "ſar 5 SAR 5 \u212aWD 5 KWD", "ÉS ét éſ", "ab a", "\ufdd0ab", None]
    got = batch.find(pa.array(own, pa.string()), [batch.Pattern(i, p, f, g, False) for i, (p, f, g) in enumerate(rules)])
    for t, found in zip(own, got.to_pylist()):
        want = t is not None and [(i, m[0], *m.span(), (m[1] or "") if g and m.re.groups else "") for i, (p, f, g) in enumerate(rules) for m in to_python(p, f).finditer(t)]
        assert (t is None and found is None) or [tuple(x.values()) for x in found] == want


def test_batches_are_cut_by_bytes(monkeypatch):
    texts = pa.array(["a@b.cd " * 50, None, "", "x a@b.cd", "é a@b.cd"])
    patterns = [batch.Pattern(0, *R.V.EMAILS[0], False, False)]
    whole = batch.find(texts, patterns)
    monkeypatch.setattr(batch, "AT_ONCE", 10)
    assert batch.find(texts, patterns).equals(whole) and [len(x or ()) for x in whole.to_pylist()] == [50, 0, 0, 1, 1]
    odd = pa.array([x for i in range(300) for x in (f"é{i} a{i}@b.cd" * (i % 7), "ſ a@b.cd")])
    each = [batch.find(odd.slice(i, 1), patterns).to_pylist()[0] for i in range(200, 600)]
    assert batch._found(odd.slice(200), patterns).to_pylist() == batch.find(odd.slice(200), patterns).to_pylist() == each
    steps = D.steps_of(Q.NOTES)
    rules = N.patterns_of(N.Patterns([(s.pattern, s.flags)], dotted=s.dotted) for s in steps)
    assert batch.sliced(lambda x: D._detections(x, steps, rules), odd.slice(200)).to_pylist() == D._detections(odd, steps, rules).to_pylist()[200:] == D._detections(odd.slice(200), steps, rules).to_pylist()
    assert len(batch.find(texts.slice(0, 0), patterns)) == 0 and batch.find(texts.slice(3), patterns).to_pylist()[1][0]["start"] == 2


@pytest.mark.parametrize("people", [(), ("maria", "Stteen", "thnding")])
def test_engine_a(spark, texts, people):
    names = ["Stteen Erachtz", "the", " a "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: [tuple(e) for e in r.entities] for r in detect(df, "t", names, people).collect()}
    rules = [R.Rule("person", 100, R.terms(names)), *R.built_in()]
    want = {i: [tuple(e) for e in R.with_people(t or "", rules, frozenset(p.lower() for p in people))] for i, t in enumerate(texts)}
    assert got == want
    assert {e[1] for x in got.values() for e in x} == {r.type for r in R.built_in()}  # each type is exercised
    assert {r.i: [tuple(e) for e in r.entities] for r in detect(df, "t", names, people, kept=3).collect()} == {i: x[:3] for i, x in want.items()}


def test_types_alone(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rules = {r.type: r for r in R.built_in()}
    kinds = [k for k in rules if k not in ("email", "credit_card", "phone")]
    got = {(r.i, r.type, r.start, r.span_text, r.confidence) for r in detect_native(df, kinds, "t").collect()}
    assert got == {(i, k, s, v, c) for i, t in enumerate(texts) if t for k in kinds for v, s, c in R.matches(rules[k], t) if v and (s, s + len(v), c) in {(x.start, x.end, x.confidence) for x in R.detect(t, [rules[k]])}}


@pytest.mark.parametrize("config", [Q.CONFIG, Q.NOTES])
def test_engine_b(spark, texts, config):
    """Everything of a detection: categories, confidence, numbers, contexts and emission too."""
    names = ["Main Street", "host"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: [e.asDict() for e in r.detections] for r in detect_rules(df, config, "t", names).collect()}
    steps, rule = R._Steps(config), R.Rule("person", 100, R.terms(names))
    assert got == {i: steps.run(t, [(v, s) for v, s, _ in R.matches(rule, t or "")]) for i, t in enumerate(texts)}


def test_places_beside_marks(spark):
    """A text that has the marks of the short way itself goes the longer way."""
    for t in ("ab ab", "﷐ab﷑ab", "﷒"):
        got = spark.createDataFrame([(t,)], "t string").select(places(F.col("t"), F.lit("a(b)"), F.lit(True))).first()[0]
        assert [tuple(x) for x in got] == [("ab", m.start(), m.end(), "b") for m in re.finditer("ab", t)]


def test_many_findings_take_time_in_proportion(spark):
    """Thirty thousand addresses in one text."""
    def took(n):
        df = spark.createDataFrame([(1, " ".join(f"user{i}@example.com" for i in range(n)))], "doc_id int, text string")
        began = time.perf_counter()
        x = mask.mask(mask.to_detections(detect(df))).select(F.size("detections"), F.size(F.split("masked_text", " "))).first()
        assert x[0] >= n and x[1] == n
        return time.perf_counter() - began

    took(100)
    few, many = took(3_000), took(30_000)
    assert many < 15 * few + 15


def _spliced(text, spans, mode):
    """Brute force of the masking modes."""
    ok = [(s, e, i, p) for i, (s, e, p) in enumerate(spans) if 0 <= s < e <= len(text)]
    if mode == "compat":
        for s, e, _, p in sorted(ok, key=lambda x: (-x[0], x[2])):
            text = text[:s] + p + text[e:]
        return text
    runs = []
    for s, e, i, p in sorted(ok, key=lambda x: (x[0], x[2])):
        if runs and s < runs[-1][1]:
            runs[-1] = (runs[-1][0], max(e, runs[-1][1]), [*runs[-1][2], (s - e, s, i, p)])
        else:
            runs.append((s, e, [(s - e, s, i, p)]))
    for s, e, own in reversed(runs):
        text = text[:s] + min(own)[-1] + text[e:]
    return text


@pytest.mark.parametrize("mode", ["safe", "compat"])
def test_masking_at_random(spark, mode):
    draw = random.Random(3)
    rows = []
    for n in range(200):
        text = "".join(draw.choice("ab🙂 ") for _ in range(draw.choice([0, 5, 40, 1500])))
        at = [(s, s + draw.randrange(0, 9), draw.choice(["[X]", "", "[LONGER]"])) for s in (draw.randrange(-1, len(text) + 2) for _ in range(draw.randrange(0, 8)))]
        rows.append((n, text, at))
    df = spark.createDataFrame([(n, t, [(s, e, p, True, i) for i, (s, e, p) in enumerate(at)]) for n, t, at in rows], "n int, t string, d array<struct<start:int,end:int,placeholder:string,approved:boolean,ord:int>>")
    got = {r.n: r.m for r in df.select("n", mask.masked(F.col("t"), F.col("d"), mode).alias("m")).collect()}
    assert got == {n: _spliced(t, at, mode) for n, t, at in rows}
    shown = {r.n: r.s for r in df.select("n", mask.segments(F.col("t"), F.filter("d", lambda d: (d["start"] >= 0) & (d["end"] <= F.length("t")))).alias("s")).collect()}
    for n, t, at in rows:
        kept = sorted((s, i, e) for i, (s, e, _) in enumerate(at) if 0 <= s < e <= len(t))
        assert [(x.piece, x.ord) for x in shown[n] if x.ord is not None] == [(t[s:e], i) for s, i, e in kept]
        if all(b[0] >= a[2] for a, b in zip(kept, kept[1:])):
            assert "".join(x.piece for x in shown[n]) == t


def test_terms(spark, monkeypatch):
    """Any terms in any texts, broadcast or shuffled, as the pattern finds them."""
    draw = random.Random(1)
    words = ["a", "b", "ab", "A_1", "é", "über", "x", "10", "c++", "...", " - ", "b-a", "İ", "日本"]
    texts = ["".join(draw.choice(words) + draw.choice([" ", "  ", "-", ".", ", ", "", "\n", "++"]) for _ in range(draw.randrange(0, 40))) for _ in range(150)] + [None, "", "x" + " . " * 50 + "b"]
    own = [None, "", " ", "a", " A ", "a b", "a b a", "ab", "b-a", "c++", "x", "++", ". ", "é", "10.10", "x  b", "a-a", "a a", "über", "日本", "b . . . b", "A_1, a"]
    own += ["".join(draw.choice(words) + draw.choice([" ", "-"]) for _ in range(draw.randrange(1, 4))).strip() for _ in range(150)]
    docs, of = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, token string"), spark.createDataFrame([(x,) for x in own], "term string")
    want = sorted((i, w, s, s + len(v)) for i, t in enumerate(texts) for w in {w.strip(" \t\n").lower() for w in own if w} - {""} for v, s, _ in R.matches(R.Rule("p", 1, R.terms([w])), t or ""))
    assert sorted(map(tuple, terms.find_terms(docs, of).collect())) == want
    monkeypatch.setattr(terms, "BROADCAST_TERMS", 3)
    assert sorted(map(tuple, terms.find_terms(docs, of).collect())) == want
    assert terms.find_terms(docs.limit(0), of).count() == terms.find_terms(docs, of.limit(0)).count() == 0


def test_terms_that_share_words(spark):
    """Short terms are met as whole runs, not at each place of a word that many of them have."""
    words = [f"{a} {b} {c}" for a in "xyz" for b in "xyz" for c in "xyz"]
    docs = spark.createDataFrame([(1, "x y x y x z, x  y; X Y Z")], "doc_id int, text string")
    found = terms.find_terms(docs, spark.createDataFrame([(w,) for w in words], "term string"))
    assert "offset" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.term, r.start) for r in found.collect()) == [("x y x", 0), ("x y z", 19), ("y x y", 2), ("y x z", 6)]


def test_equal_runs_of_a_batch_are_one_row(spark):
    """What is shuffled is a row for each run that a term may be, not for each place; rows that repeat a document each give theirs."""
    docs = spark.createDataFrame([(1, "a a a, b"), (1, "A a"), (2, "a c c"), (3, None)], "doc_id int, text string").coalesce(1)
    of = spark.createDataFrame([("a a",), ("a",), ("b",)], "term string")
    met = terms._runs(docs, "doc_id", "text", [1, 3], terms._filter(of, 3))
    assert sorted((r.term, list(zip(r.docs, r.at))) for r in met.collect()) == [("a", [(1, 0), (1, 2), (1, 4), (1, 0), (1, 2), (2, 0)]), ("a a", [(1, 0), (1, 0)]), ("b", [(1, 7)])]
    assert sorted(tuple(r) for r in terms.find_terms(docs, of.where("term <> 'a'")).collect()) == [(1, "a a", 0, 3), (1, "a a", 0, 3), (1, "b", 7, 8)]


def test_people(spark, texts):
    names = ["Maria", " stteen ", "thnding", None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = sorted(tuple(r)[::2] + (r.end,) for r in terms.people(docs, spark.createDataFrame([(n,) for n in names], "name string")).collect())
    assert got == sorted({(i, s, s + len(v)) for i, t in enumerate(texts) if t for v, s, _ in R.people(t, frozenset(["maria", "stteen", "thnding"]))})


@pytest.mark.parametrize("threshold", [100, 98, 85, 67, 50])
def test_similar_hashes(spark, threshold):
    draw = random.Random(2)
    base = [draw.getrandbits(64) for _ in range(8)]
    near = lambda v: v ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(0, 25)))
    rows = [(i, f"{near(draw.choice(base)):016x}") for i in range(150)] + [(200, None), (201, "ab"), (202, f"{base[0]:016X}"), (203, f"{base[0]:016x}"), (204, "f" * 16), (205, "7" + "f" * 15)]
    x, y = spark.createDataFrame(rows, "image_id int, hash string"), spark.createDataFrame([(i, h) for i, h in rows if i % 3 == 0 or i > 199], "target_id int, hash string")
    got = {(r.image_id, r.target_id): (r.distance, r.similarity) for r in images.similar(x, y, threshold).collect()}
    ok = [(i, int(h, 16)) for i, h in rows if h and len(h) == 16]
    every = {(i, j): (v ^ w).bit_count() for i, v in ok for j, w in ok if j % 3 == 0 or j > 199}
    like = lambda d: int((64 - d) / 64 * 10_000 + 0.5) / 100
    assert got == {k: (d, like(d)) for k, d in every.items() if like(d) >= threshold}


@pytest.mark.parametrize("many", [0, 700])
def test_hashes_that_bands_do_not_part_are_compared_by_blocks(spark, monkeypatch, many):
    """At 67 % bands let more pairs meet than there are; blocks that aren't full, copies, rows without a hash."""
    monkeypatch.setattr(images, "BLOCK", 64)
    monkeypatch.setattr(images, "AT_ONCE", 1000)
    draw = random.Random(4)
    rows = [(i, f"{draw.getrandbits(64):016x}") for i in range(many)] + [(900 + i, "00ff" * 4) for i in range(30)] + [(990, None), (991, "abc")]
    x = spark.createDataFrame(rows, "image_id int, hash string")
    y = x.where("image_id % 3 = 0").withColumnRenamed("image_id", "target_id")
    found = images.similar(x, y, 67)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" not in plan and "band" not in plan
    ok = [(i, int(h, 16)) for i, h in rows if h and len(h) == 16]
    want = sorted((i, j, (v ^ w).bit_count()) for i, v in ok for j, w in ok if j % 3 == 0 and (v ^ w).bit_count() <= 21)
    assert sorted((r.image_id, r.target_id, r.distance) for r in found.collect()) == want and len(want) >= 300


def test_mean_of_a_picture_is_taken_once(spark):
    """Neither for each pixel nor for each part of the hash."""
    df = spark.createDataFrame([([0.0] * 63 + [1.0],), ([3.0] * 64,), (None,)], "p array<double>").select(images.average_hash(F.transform("p", lambda x: x * 2)).alias("h"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    assert [r.h for r in df.collect()] == ["0" * 15 + "1", "0" * 16, None]
