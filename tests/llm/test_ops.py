"""The ten operators against brute force and SQL, and their edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from blobloom.llm import common, decontam, language_id, line_dedup, mixing, oracles, quality, queries, sharding, simhash, substring_dedup, token_rollup, topk

from ..compare import same

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, u long, w string, shard int, row string"


def docs(spark, rows):
    """Documents with nulls where a row is short, and extra columns whose names clash with inner ones."""
    full = [(tuple(r) + (None,) * 4)[:4] + (None, 1, 2, "w", 3, "row") for r in rows]
    return spark.createDataFrame(full, DOCS)


def odd(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return docs(spark, [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, "  \n\t ", "de", None), (4, long, None, "b"), (5, long, None, "b"),
        (6, "One two three. Four five six.", "en", "a"), (6, "One two three. Four five six.", "en", "a"), (None, "no id here", "fr", "c"),
        (None, None, None, None), (7, "x", "en", "a"), (8, "É ß Ünï ÇÉ", "fr", "c"), (9, "!!! ??? ...", "en", "b"),
    ])


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(queries.queries()[name](spark, SF), oracles.oracle_sql()[name], SF)


# --- 1 mixing ---



def mixed(df, **kw):
    return [r.asDict() for r in mixing.mix(df, **kw).collect()]


def test_mixing_targets_and_counts(spark):
    r = random.Random(1)
    rows = [(i, "w " * r.randrange(0, 30), "en", f"s{min(i % 7, 3)}") for i in range(600)]
    out = mixed(docs(spark, rows))
    size = Counter()
    for i, t, _, s in rows:
        size[s] += len(t.split())
    total = sum(size.values())
    left, target, weight = 1.5 * total, {}, dict(zip(sorted(size), (5, 2, 1, 5)))
    open_ = set(size)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 2 * size[s]}
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= full
    taken = Counter()
    for x in out:
        assert math.isclose(x["target"], target[x["source"]], rel_tol=1e-12)
        assert x["source_size"] == size[x["source"]] and x["taken"] <= 2 * x["size"] and x["taken"] == x["repetitions"] * x["size"]
        taken[x["source"]] += x["taken"]
    for s in size:
        assert abs(taken[s] - target[s]) <= 30
    assert out == sorted(out, key=lambda x: out.index(x)) and sorted(map(str, out)) == sorted(map(str, mixed(docs(spark, rows))))


def test_mixing_odd_rows(spark):
    out = mixed(odd(spark))
    assert len(out) == 12 and {x["source"] for x in out} == {"a", "b", "c", None}
    assert all(x["taken"] <= 2 * x["size"] for x in out)
    assert mixed(docs(spark, [])) == []
    kept = mixing.mix(odd(spark), keep=True)
    assert kept.columns == odd(spark).columns
    n = Counter(r.doc_id for r in kept.collect())
    want = Counter()
    for x in out:
        want[x["doc_id"]] += x["repetitions"]
    assert n == +want


def test_mixing_given_weights(spark):
    rows = [(i, "a b c d", "en", "x" if i % 2 else "y") for i in range(200)]
    out = mixed(docs(spark, rows), weights={"x": 3.0, "y": 1.0}, budget=1.0)
    t = {x["source"]: x["target"] for x in out}
    assert t == {"x": 600.0, "y": 200.0}


# --- 2 decontamination ---

def brute_words(t):
    import re

    low = (t or "").translate(str.maketrans(common.UPPER, common.UPPER.lower()))
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute_contamination(rows, items):
    wins = defaultdict(set)
    for item, t in items:
        w = brute_words(t)
        k = min(8, len(w))
        if item is not None:
            for i in range(len(w) - k + 1 if k else 0):
                wins[tuple(w[i : i + k])].add(str(item))
    out = []
    for d, t in rows:
        w = brute_words(t)
        hit, found = set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wins:
                    hit |= set(range(i, i + k))
                    found |= wins[tuple(w[i : i + k])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=repr)


ITEMS = [(1, "the quick brown fox jumps over the lazy dog again and again"), (2, "One two, three!"), (3, ""), (4, None), (None, "one two"), (10, "a a a a a a a a a a"), (5, "ÉÉ ß é"), (2, "four five")]


@pytest.mark.parametrize("bound", [200_000, 0])
def test_decontamination_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(common, "BROADCAST_ROWS", bound)  # 0: the way without broadcasts
    r = random.Random(2)
    vocabulary = "the quick brown fox jumps over lazy dog again and one two three four five a ÉÉ ß é zzz".split()
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(40)))) for i in range(60)]
    rows += [(100, "X the QUICK brown-fox jumps over the lazy dog. one two three"), (101, None), (102, ""), (100, "a " * 30), (103, "a " * 30), (103, "a " * 30), (None, "one two three")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.contamination(docs(spark, rows), items).drop("text_key").collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute_contamination(rows, ITEMS)


def test_decontamination_odd(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.contamination(odd(spark), items).count() == 12
    assert decontam.contamination(docs(spark, []), items).count() == 0
    none = decontam.contamination(odd(spark), items.limit(0))
    assert none.count() == 12 and none.filter("contaminated or n_hit > 0").count() == 0
    kept = decontam.decontaminate(odd(spark), items)
    assert kept.columns == odd(spark).columns and sorted(str(x.doc_id) for x in kept.collect()) == sorted(["1", "2", "3", "4", "5", "7", "8", "9", "None", "None"])


# --- 3 quality ---

def test_quality_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(d, lab)
    got = {r.doc_id: r for r in quality.score(d, model).collect()}
    held = [r for r in lab.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(got[r.doc_id].held_out for r in held)
    assert np.mean([got[r.doc_id].predicted == r.quality for r in held]) > 0.95
    bad = [r for r in held if r.quality == 0]
    assert np.mean([got[r.doc_id].predicted == 0 for r in bad]) > 0.8
    odd_rows = quality.score(odd(spark), model).collect()
    assert len(odd_rows) == 12 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd_rows)
    assert quality.score(docs(spark, []), model).count() == 0


def test_quality_gradient():
    r = np.random.default_rng(0)
    m = quality.Model(np.zeros(6), np.ones(6), 0.4)
    x, starts, label, weight = r.normal(size=(9, 6)), np.array([0, 2, 3]), np.array([1.0, 0, 1]), np.array([1.0, 2, 1])

    def loss():
        y = m.forward(x, starts)[-1]
        return -(weight * (label * np.log(y) + (1 - label) * np.log(1 - y))).sum() / weight.sum()

    g = m.gradient(x, starts, label, weight)
    for k in m.NAMES:
        p = m.p[k]
        at = tuple(0 for _ in p.shape)
        keep = p[at] if p.shape else float(p)
        eps = 1e-6
        ends = []
        for s in (eps, -eps):
            if p.shape:
                p[at] = keep + s
            else:
                m.p[k] = np.array(keep + s)
            ends.append(loss())
        if p.shape:
            p[at] = keep
        else:
            m.p[k] = np.array(keep)
        assert abs((ends[0] - ends[1]) / (2 * eps) - (g[k][at] if p.shape else g[k])) < 1e-6


def test_quality_brute_force(spark):
    """Attention over passages in plain loops, on the model that the query fits."""
    d = common.read(spark, SF, "documents")
    m = quality.train(d, common.read(spark, SF, "labels"))
    p = {k: np.asarray(v).tolist() for k, v in m.p.items()}
    sig = lambda x: 1 / (1 + math.exp(-x))

    def times(x, w):
        return [sum(x[i] * w[i][j] for i in range(len(x))) for j in range(len(w[0]))]

    def brute(text):
        hidden, weight = [], []
        for row in quality.encode((text or "").encode()).tolist():
            x = [(v - a) / b for v, a, b in zip(row, m.mean.tolist(), m.scale.tolist())]
            h = [math.tanh(v + b) for v, b in zip(times(x, p["W"]), p["b"])]
            gate = [math.tanh(t) * sig(u) for t, u in zip(times(h, p["V"]), times(h, p["U"]))]
            hidden.append(h)
            weight.append(math.exp(sum(g * w for g, w in zip(gate, p["w"]))))
        z = [sum(a * h[k] for a, h in zip(weight, hidden)) / sum(weight) for k in range(len(hidden[0]))]
        return sig(sum(a * b for a, b in zip(z, p["c"])) + p["d"])

    text = {r.doc_id: r.text for r in d.collect()}
    got = {r.doc_id: r for r in quality.score(d, m).collect()}
    for i in sorted(text)[:60]:
        assert abs(got[i].score - brute(text[i])) < 1e-5
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].predicted == int(got[i].score >= 0.5)


def test_quality_no_labels(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(odd(spark), quality.train(odd(spark), lab)).count() == 12


def test_passages_cover_long_texts():
    x = quality.encode(b"ab cd " * 200_000)
    assert len(x) == 2000 and np.allclose(x[:, :10].sum(axis=1), 1)


# --- 4 substring dedup ---

def test_substring_removal(spark):
    passage = "This passage has many words in it, and goes on. It has a second sentence of some length too. " * 2
    rows = [(1, f"Alpha beta gamma.\n{passage}\nend one"), (2, f"start two and {passage.strip()} tail"), (3, "Alpha beta gamma.\nclean"), (4, None), (5, "")]
    d = docs(spark, rows)
    spans = substring_dedup.repeats(d)
    # what repeats within document 1 is shorter than MIN_WORDS
    assert {(r.doc_id, r.kept_doc_id) for r in spans.collect()} == {(2, 1)}
    cleaned = {r.doc_id: r.text for r in substring_dedup.remove(d, spans).collect()}
    assert cleaned[3] == rows[2][1] and cleaned[4] is None and cleaned[5] == ""
    assert cleaned[2] == "start two and tail"
    assert substring_dedup.remove(d, spans).columns == d.columns


def test_substring_lines_under_headings(spark):
    """A repeated line is found whatever stands before and after it, however short that is."""
    line = " ".join(f"word{i}" for i in range(60))
    rows = [(1, f"Ab cd\n{line}\n\nend"), (2, f"Xy\n{line}\nother end"), (3, f"{line}"), (4, f"A B C {line.upper()}")]
    got = {r.doc_id: (dict(rows)[r.doc_id][r.start : r.stop], r.n_words, r.kept_doc_id) for r in substring_dedup.repeats(docs(spark, rows)).collect()}
    assert got == {2: (line + "\n", 60, 1), 3: (line, 60, 1)}


def test_substring_short_lines(spark):
    """Later occurrences of whole lines go, however short a run they make; pieces within lines and lines of four words don't."""
    line = "All rights reserved. See the License."
    rows = [(i, f"text number {i}\n{line}\nown words {i} {i} {i}\nof four words only\n") for i in range(4)]
    rows.append((9, f"a line that goes on. {line} and more"))
    d = docs(spark, rows)
    spans = substring_dedup.repeats(d)
    got = {r.doc_id: (dict(rows)[r.doc_id][r.start : r.stop], r.n_words, r.kept_doc_id) for r in spans.collect()}
    assert got == {i: (f"{line}\n", 6, 0) for i in (1, 2, 3)} and spans.count() == 3
    assert {r.doc_id: r.text for r in substring_dedup.remove(d, spans).collect()} == {i: t if i in (0, 9) else t.replace(f"{line}\n", "") for i, t in rows}


@pytest.mark.parametrize("hot", [1 / 500, 1 / 4])
def test_substring_hot_line(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    rows = [(i, f"one own line number {i} here\nthis line is in every one of them\n") for i in range(300)]
    got = substring_dedup.repeats(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.kept_doc_id) for r in got) == [(i, 8, 0) for i in range(1, 300)]


def test_substring_odd(spark):
    got = {(r.doc_id, r.start, r.stop, r.kept_doc_id) for r in substring_dedup.repeats(odd(spark)).collect()}
    text = " ".join(f"w{i % 977}" for i in range(30_000))
    assert got == {(5, 0, len(text), 4)}
    assert substring_dedup.repeats(docs(spark, [])).count() == 0
    pair = docs(spark, [(None, "word " * 40), (3, "word " * 40)])
    assert [(r.doc_id, r.kept_doc_id) for r in substring_dedup.repeats(pair).collect()] == [(None, 3)]


# --- 5 line dedup ---

PAGES = "page_id long, url string, html string, host string, lines string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "l") for r in rows], PAGES)


def test_line_dedup(spark):
    rows = [(i, f"http://a.com/{i}", f"<p>menu</p><script>x</script><p>own {i} &amp; more</p>") for i in range(10)]
    rows += [(20 + i, f"https://B.com:80/{i}", f"<div>menu</div><br>t{i}") for i in range(3)]
    rows += [(40, None, "<p>menu"), (41, "no address", None), (None, "http://a.com/x", ""), (1, "http://a.com/1", "<p>menu</p><p>own 1 &amp; more</p>")]
    out = {}
    for r in line_dedup.clean(pages(spark, rows)).collect():
        out.setdefault(r.page_id, []).append((r.host, r.n_lines, r.n_dropped, r.text))
    assert out[0] == [("a.com", 2, 1, "own 0 & more")]
    assert out[20] == [("b.com", 2, 0, "menu\nt0")]  # too few pages to tell
    assert out[40] == [("", 1, 0, "menu")] and out[41] == [("", 0, 0, "")] and out[None] == [("a.com", 0, 0, "")]
    assert out[1] == [("a.com", 2, 1, "own 1 & more")] * 2
    assert line_dedup.clean(pages(spark, [])).count() == 0


@pytest.mark.parametrize("bound", [200_000, 0])
def test_line_dedup_of_a_large_host(spark, monkeypatch, bound):
    """One host with most pages, some small ones and some without boilerplate; with and without broadcasts of all lists."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(common, "HOT", 1 / 10)
    long = "".join(f"<p>line {i}</p>" for i in range(20_000))
    rows = [(i, "http://big.org/x", f"<p>menu</p><p>foot</p><p>own {i}</p>") for i in range(200)]
    rows += [(300 + i, f"http://s{i % 5}.net/x", f"<p>nav {i % 5}</p><p>text {i}</p>") for i in range(30)]
    rows += [(400 + i, f"http://none{i}.net/x", "<p>menu</p>") for i in range(10)] + [(500, "http://big.org/x", long)]
    got = {r.page_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.clean(pages(spark, rows)).collect()}
    assert len(got) == 241
    assert all(got[i] == (3, 2, f"own {i}") for i in range(200))
    assert all(got[300 + i] == (2, 1, f"text {i}") for i in range(30))
    assert all(got[400 + i] == (1, 0, "menu") for i in range(10))
    assert got[500][:2] == (20_000, 0)


# --- 6 token counts ---

def rolled(r):
    return {(x.source, x.lang): (x.n_docs, x.n_tokens) for x in r.totals().collect()}


def brute_tokens(rows):
    out = defaultdict(lambda: [0, 0])
    for r in rows:
        out[r.source, r.lang][0] += 1
        out[r.source, r.lang][1] += token_rollup.count_tokens(r.text)
    return {k: tuple(v) for k, v in out.items()}


def test_token_rollup(spark):
    d = odd(spark)
    r = token_rollup.fresh(spark)
    assert r.totals().count() == 0
    assert r.commit("b1", token_rollup.counted(d))
    assert not r.commit("b1", token_rollup.counted(d))
    assert rolled(r) == brute_tokens(d.collect())
    old = d.filter("doc_id = 6").limit(1)
    new = old.withColumn("text", F.lit("a revised text of other length"))
    assert r.commit("b2", token_rollup.delta(old, new))
    gone = d.filter("source = 'c'")
    assert r.commit("b3", token_rollup.counted(gone, sign=-1))
    want = brute_tokens([*d.filter("doc_id is distinct from 6 and source is distinct from 'c'").collect(), d.filter("doc_id = 6").first(), new.first()])
    assert rolled(r) == want
    r.compact()
    assert rolled(r) == want and not r.commit("b2", token_rollup.counted(d))
    assert r.commit("b4", token_rollup.counted(gone))
    r.compact()
    r.compact()
    assert rolled(r) == brute_tokens([*d.filter("doc_id is distinct from 6").collect(), d.filter("doc_id = 6").first(), new.first()])
    assert len(r.batches()) == 1
    with pytest.raises(ValueError):
        r.commit("a/b", token_rollup.counted(d))


def test_token_query_counts_all(spark):
    got = {(x.source, x.lang): (x.n_docs, x.n_tokens) for x in queries.op6_token_counts(spark, SF).collect()}
    assert got == brute_tokens(common.read(spark, SF, "documents").collect())


def test_token_rollup_empty(spark):
    r = token_rollup.fresh(spark)
    none = docs(spark, [])
    assert token_rollup.counted(none).count() == 0 and token_rollup.delta(none, none).count() == 0
    assert r.commit("none", token_rollup.counted(none)) and not r.commit("none", token_rollup.counted(odd(spark)))
    assert r.totals().count() == 0
    r.compact()
    assert r.totals().count() == 0 and r.committed("none")
    r.drop()


def test_token_rollup_of_two_writers(spark):
    """A writer that finds the batch only when it renames loses, and leaves nothing."""
    r, s = token_rollup.fresh(spark), None
    s = token_rollup.Rollup(spark, r.folder)
    assert r.commit("a", token_rollup.counted(odd(spark)))
    want = rolled(r)
    s.committed = lambda _: False  # it looked before the other was done
    there, s._fs = s._fs, Unseen(s._fs, "batch=a")
    assert not s.commit("a", token_rollup.counted(odd(spark)))
    s._fs = there
    assert rolled(r) == want and [p.getPath().getName() for p in there.listStatus(r._at("batch=a")) if "draft" in p.getPath().getName()] == []


class Unseen:
    """A file system whose ``exists`` doesn't see a name the first time."""

    def __init__(self, fs, name):
        self.fs, self.name, self.asked = fs, name, 0

    def exists(self, path):
        self.asked += path.getName() == self.name
        return self.fs.exists(path) and not (path.getName() == self.name and self.asked == 1)

    def __getattr__(self, name):
        return getattr(self.fs, name)


# --- 7 language ID ---

def test_language_id(spark):
    d = common.read(spark, SF, "documents")
    got = language_id.identify(language_id.of_documents(d), ["doc_id"]).collect()
    assert len(got) == d.count()
    assert np.mean([r.lang == r.declared for r in got]) > 0.98
    # declarations that contradict the text don't win
    swapped = d.withColumn("lang", F.when(F.col("doc_id") % 20 == 0, F.lit("xx")).when(F.col("doc_id") % 20 == 1, F.lit("de")).otherwise(F.col("lang")))
    true = {r.doc_id: r.lang for r in d.collect()}
    got = language_id.identify(language_id.of_documents(swapped), ["doc_id"]).collect()
    assert np.mean([r.lang == true[r.doc_id] for r in got]) > 0.97


def test_language_id_rejects(spark):
    d = common.read(spark, SF, "documents").select("doc_id", "text", "lang", "source")
    r = random.Random(4)
    junk = [(10_000 + i, "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(400)), "en", "src1") for i in range(5)]
    bad = spark.createDataFrame([*junk, (20_000, "12 34 !! ##", "en", "src1"), (20_001, None, "en", "src1"), (20_002, "", None, None)], "doc_id long, text string, lang string, source string")
    kept = {x.doc_id for x in language_id.keep_identified(d.union(bad)).collect()}
    assert kept == {x.doc_id for x in d.collect()}


def test_language_id_odd(spark):
    got = language_id.identify(language_id.of_documents(odd(spark)), ["doc_id"])
    assert got.count() == 12
    assert language_id.identify(language_id.of_documents(docs(spark, [])), ["doc_id"]).count() == 0
    assert language_id.keep_identified(odd(spark)).columns == odd(spark).columns


def brute_language(rows, model):
    """Fusion as the module's text states it, in plain loops: log likelihood, declaration, host prior."""
    names = model.names
    n = len(names)

    def softmax(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    ll = [model.evidence(r["text"].encode() if r["text"] is not None else None) for r in rows]
    post = [softmax(x) for x in ll]
    letters = [r["text"] is not None and any(c.isalpha() for c in r["text"]) for r in rows]
    text_lang = [names[p.index(max(p))] if ok else "und" for p, ok in zip(post, letters)]
    right, heard = Counter(), Counter()
    for r, t in zip(rows, text_lang):
        if r["declared"] in names[:-1] and t != "und":
            heard[t] += 1
            right[t] += r["declared"] == t
    rate = {x: (right[x] + 1) / (heard[x] + 2) if heard[x] else 0.5 for x in names}
    host, suffix, everything = defaultdict(lambda: [0.0] * n), defaultdict(lambda: [0.0] * n), [0.0] * n
    for r, p, ok in zip(rows, post, letters):
        if ok:
            for t in (host[r["host"], r["suffix"]], suffix[r["suffix"]], everything):
                for i in range(n):
                    t[i] += p[i]
    total = sum(everything) or 1.0
    base = [(x + 1) / (total + n) for x in everything]
    smooth = lambda t, parent, weight: [(t[i] + weight * parent[i]) / (sum(t) + weight) for i in range(n)]
    out = []
    for r, x, ok in zip(rows, ll, letters):
        prior = smooth(host[r["host"], r["suffix"]], smooth(suffix[r["suffix"]], base, language_id.SUFFIX_WEIGHT), language_id.HOST_WEIGHT)
        score = [a + math.log(b) for a, b in zip(x, prior)]
        if r["declared"] in names[:-1]:
            for i, name in enumerate(names[:-1]):
                p = rate[name] if name == r["declared"] else max((1 - rate[name]) / max(1, n - 2), 1e-6)
                score[i] += math.log(p)
            score[-1] += math.log(1 / max(1, n - 1))
        p = softmax(score)
        best = names[p.index(max(p))]
        lost = best == "und" or max(p) < language_id.REJECT_BELOW
        other = r["declared"] is not None and r["declared"] not in names
        out.append((r["k"], None if not ok or (lost and not other) else r["declared"] if lost else best, round(max(p), 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bound", [200_000, 0])
def test_language_brute_force(spark, monkeypatch, bound):
    """Counts of trigrams, fusion and the hierarchy of priors; one host has most rows."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(common, "HOT", 1 / 10)
    d = common.read(spark, SF, "documents").select("doc_id", "text", "lang")
    host = F.when(F.col("doc_id") % 3 > 0, "big.de").when(F.col("doc_id") % 7 == 0, None).otherwise(F.concat(F.lit("h"), (F.col("doc_id") % 13).cast("string")))
    said = F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 17 == 0, "xx").when(F.col("doc_id") % 19 == 0, "de").otherwise(F.col("lang"))
    text = F.when(F.col("doc_id") % 23 == 0, F.lit("12 34")).when(F.col("doc_id") % 29 == 0, F.lit("\u4e00\u4e01 \u5200" * 90)).otherwise(F.col("text"))
    rows = d.select(F.col("doc_id").alias("k"), said.alias("declared"), host.alias("host"), F.when(F.col("doc_id") % 3 > 0, "de").otherwise("").alias("suffix"), text.alias("text"))
    model = language_id.fit(rows)
    counts = defaultdict(lambda: np.zeros(language_id.BUCKETS))
    seen = [r.asDict() for r in rows.collect()]
    for r in seen:
        if r["declared"] in model.names and r["text"] is not None:
            counts[r["declared"]] += language_id.trigrams(r["text"].encode())
    for i, name in enumerate(model.names[:-1]):
        c = counts[name] + 0.5
        assert np.allclose(model.log_p[i], np.log(c / c.sum()))
    got = sorted(((r.k, r.lang, round(r.probability, 6)) for r in language_id.identify(rows, ["k"]).collect()), key=repr)
    want = brute_language(seen, model)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=2e-6)
    assert {x[1] for x in want} > {None, "de", "en"}


def test_language_without_a_model(spark):
    """A declared language with too few rows for a model is kept; junk without declaration is not."""
    rows = [(i, "une phrase en français, rare ici", "fr", "a") for i in range(3)] + [(9, "no declaration", None, "a"), (10, "12 !", "fr", "a")]
    got = {r.doc_id: (r.lang, r.rejected) for r in language_id.identify(language_id.of_documents(docs(spark, rows)), ["doc_id"]).collect()}
    assert got == {0: ("fr", False), 1: ("fr", False), 2: ("fr", False), 9: (None, True), 10: (None, True)}


def test_language_of_odd_pages(spark):
    long = "<html lang=en>" + "the word of the day and so on " * 20_000
    rows = [(1, None, None), (2, "", ""), (3, "http://a.de/x", "<html lang='de'><p>Das ist ein Text</p>"), (3, "http://a.de/x", "<html lang='de'><p>Das ist ein Text</p>"), (4, "x", "<p>12</p>"), (5, "http://b.org", long), (None, "http://b.org", "<p>text</p>")]
    got = language_id.identify(language_id.of_pages(pages(spark, rows)), ["page_id"])
    out = {r.page_id: (r.lang, r.declared) for r in got.collect()}
    assert got.count() == 7 and out[1] == out[2] == out[4] == (None, None) and out[3] == ("de", "de") and out[5] == ("en", "en")
    assert language_id.identify(language_id.of_pages(pages(spark, [])), ["page_id"]).count() == 0


def test_language_of_pages(spark):
    got = queries.language_id_pages(spark, SF).collect()
    assert np.mean([r.lang == r.declared for r in got if r.declared]) > 0.8


# --- 8 top-k ---

def brute_top(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize(("block", "asked"), [(4096, 512), (40, 3)])
def test_top_k(spark, monkeypatch, block, asked):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", asked)
    r = np.random.default_rng(3)
    base = r.normal(size=(12, 8)).astype(np.float32)
    rows = [(int(i), [float(x) for x in base[i % 12] * (1 + (i % 5))]) for i in range(400)]
    rows += [(450, None), (500, [float("nan")] * 8), (550, [1.0, None] * 4), (None, [9.0] * 8), (600, [0.0] * 8), (601, [float("inf")] * 8)]
    t = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, label int, norm2 double")
    assert sorted(tuple(x) for x in topk.top_k(t).collect()) == brute_top([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])


def test_top_k_odd(spark):
    kind = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], kind)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0, 2.0])], kind)).count() == 0
    assert topk.top_k(spark.createDataFrame([(1, [1.0]), (2, [2.0])], kind)).count() == 0
    got = topk.top_k(spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0]), (2, [2.0, -1.0])], kind)).collect()
    assert [tuple(r) for r in sorted(got)] == [(0, 1, 1, 65536), (0, 2, 2, 65536)]
    big = topk.top_k(spark.createDataFrame([(0, [3e6, 1.0]), (1, [2e6, 1.0]), (2, [2e6, 2.0])], "vec_id long, embedding array<double>"))
    assert [(r.vec_id, r.score) for r in sorted(big.collect())] == [(2, 256 * 256 * (6 * 10**12 + 2)), (1, 256 * 256 * (6 * 10**12 + 1))]


# --- 9 SimHash ---

def brute_print(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, budget):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                parent[a] = b
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_simhash_brute_force(spark):
    d = common.read(spark, SF, "documents").collect()
    p = [brute_print(r.text) for r in d]
    c = brute_components([r.doc_id for r in d], p, 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash(spark, SF).collect()}
    assert got == {r.doc_id: (f"{x:016x}", k) for r, x, k in zip(d, p, c)}


def test_spark_hash_is_the_same(spark):
    for t in ("", "a b c", "é ü ß", "x" * 100):
        assert spark.createDataFrame([(t,)], "t string").select(F.xxhash64("t")).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(t.encode(), 42)


def labels(pairs, n):
    f = simhash.Forest(n)
    if pairs:
        i, j = np.array(sorted(pairs)).T
        f.link(i, j)
    return f.label.tolist()


@pytest.mark.parametrize("plain", [256, 8])
def test_trie_walk(monkeypatch, plain):
    monkeypatch.setattr(simhash, "PLAIN", plain)
    monkeypatch.setattr(simhash, "LEAF", 4)
    r = np.random.default_rng(8)
    x = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = x[:100] ^ (np.uint64(1) << r.integers(0, 61, 100, dtype=np.uint64))
    a = np.sort(np.concatenate([x, near, near ^ np.uint64(4), x[:20]]))
    b = np.sort(np.concatenate([near ^ np.uint64(3), x[50:]]))
    every = lambda i, j: (i + j) >= 0
    odd_only = lambda i, j: (i + j) % 3 > 0
    for width, shift in ((64, 0), (32, 32)):
        for budget in (0, 1, 2, 3):
            for near_ in (every, odd_only):
                u, v = np.sort(a >> np.uint64(shift)), np.sort(b >> np.uint64(shift))
                apart = lambda p, q: (int(p) ^ int(q)).bit_count() <= budget  # noqa: E731, B023
                want = {(i, j) for i in range(len(u)) for j in range(i) if apart(u[i], u[j]) and near_(i, j)}
                assert simhash.Walk(u, width, budget, near_).run().tolist() == labels(want, len(u))
                n = len(u)
                want = {(i, n + j) for i in range(n) for j in range(len(v)) if apart(u[i], v[j]) and near_(i, n + j)}
                assert simhash.Walk(np.concatenate([u, v]), width, budget, near_, n).run().tolist() == labels(want, n + len(v))


def test_walk_of_a_large_cluster(monkeypatch):
    """Equal and close fingerprints in one node, among others: joined without walking all pairs."""
    r = np.random.default_rng(3)
    x = np.concatenate([np.uint64(12345) ^ (np.uint64(1) << r.integers(0, 30, 30_000, dtype=np.uint64)), r.integers(0, 1 << 32, 3000, dtype=np.uint64)])
    x.sort()
    tried = []
    walk = simhash.Walk(x, 32, 3, lambda i, j: tried.append(len(i)) or np.ones(len(i), bool))
    label = walk.run()
    assert np.bincount(label).max() >= 30_000 and sum(tried) < 100 * len(x)


def test_bands_leave_a_set_whole():
    """Whatever bits differ, some set of bands agrees, and larger tables get sets of more bits, not ever more blocks."""
    r = random.Random(8)
    for width, budget in ((64, 2), (32, 3), (64, 0)):
        for n in (10, 10**8, 10**10, 10**14):
            sets = simhash.bands(n, width, budget)
            assert all(0 <= x < y <= width for s in sets for x, y in s) and all(sum(y - x for x, y in s) <= 32 for s in sets)
            for _ in range(200):
                off = [r.randrange(width) for _ in range(budget)]
                assert any(all(not x <= o < y for o in off for x, y in s) for s in sets)
    assert [len(simhash.bands(n, 32, 3)) for n in (10**7, 10**8, 10**9)] == [4, 10, 20]
    assert len(simhash.bands(10**10, 64, 2)) == 3


@pytest.mark.parametrize(("bucket", "m"), [(1 << 16, 1), (24, 1), (24, 2), (24, 3)])
def test_links_when_dealt_out(spark, monkeypatch, bucket, m):
    bands = simhash.bands
    monkeypatch.setattr(simhash, "bands", lambda n, width, budget: bands(n, width, budget, (m,)))
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = random.Random(6)
    x = [r.getrandbits(64) for _ in range(150)]
    x += [v ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for v in x[:60]] + [v ^ (1 << r.randrange(64)) for v in x[:30]]
    x += [x[0] ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]  # a bucket of many
    x = sorted(set(x))
    signed = [v - (1 << 64) if v >> 63 else v for v in x]
    keys = spark.createDataFrame([(s, s) for s in signed], "id long, s0 long")
    got = {r.node: r.label for r in simhash.components(simhash.links(keys, ["s0"], 64, 2)).collect()}
    assert [got.get(s, s) for s in signed] == brute_components(signed, x, 2)


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(101, 100), (102, 100)], "a long, b long")
    got = {r.node: r.label for r in simhash.components(e).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
    assert simhash.components(e.limit(0)).count() == 0


def test_simhash_odd(spark):
    got = simhash.simhash_components(odd(spark)).collect()
    assert len(got) == 12
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.fingerprint, r.component_id))
    assert by[1] == by[2] == by[3] == {("0" * 16, 1)} and by[5] == {(next(iter(by[4]))[0], 4)}
    assert simhash.simhash_components(docs(spark, [])).count() == 0
    assert [r.component_id for r in simhash.simhash_components(docs(spark, [(None, "a"), (None, "a")])).collect()] == [None, None]


def test_chunks_don_t_change_prints(monkeypatch):
    text = " ".join(f"w{i}" for i in range(1000)).encode()
    want = {k: simhash.fingerprint(text, k) for k in (1, 3, 5)}
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert {k: simhash.fingerprint(text, k) for k in (1, 3, 5)} == want
    assert want[3] & (1 << 64) - 1 == brute_print(text.decode())


def near_rows(n=60):
    r = random.Random(9)
    vocabulary = [f"v{r.randrange(10**6)}" for _ in range(3000)]
    rows = []
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(300)]
        rows.append((i, " ".join(w), "en", "a"))
        if i % 3 == 0:
            for _ in range(2):
                w[r.randrange(300)] = r.choice(vocabulary)
            rows.append((1000 + i, " ".join(w), "en", "b"))
        if i % 5 == 0:
            rows.append((2000 + i, rows[[x[0] for x in rows].index(i)][1], "en", "b"))
    return rows


def test_near_dedup(spark):
    rows = near_rows()
    kept = {r.doc_id for r in simhash.near_dedup(docs(spark, rows)).collect()}
    assert kept >= set(range(60)) and not any(2000 <= k for k in kept)
    assert not any(1000 <= k < 2000 for k in kept)  # two words of 300 are other ones


def brute_near(texts):
    """Pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return {(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}


@pytest.mark.parametrize("block", [512, 4])
def test_near_groups_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(5)
    texts = []
    for n in (6, 20, 90, 150, 270, 900):  # copies from just below to well above the threshold, and clusters of them
        for _ in range(8):
            w = [f"{n}w{r.randrange(10**6)}" for _ in range(n)]
            texts.append(" ".join(w))
            for _ in range(5):
                v = list(w)
                for _ in range(r.randrange(1, 2 + n // 40)):
                    v[r.randrange(n)] = f"x{r.randrange(10**6)}"
                texts.append(" ".join(v))
    want = simhash.Forest(len(texts))
    pairs = np.array(sorted(brute_near(texts)))
    assert len(pairs) > 100
    want.link(pairs[:, 0], pairs[:, 1])
    got = simhash.near_duplicates(docs(spark, list(enumerate(texts)))).collect()
    least = {}
    for x in got:
        least[x.group_id] = min(x.doc_id, least.get(x.group_id, x.doc_id))
    assert {x.doc_id: least[x.group_id] for x in got} == dict(enumerate(want.label.tolist()))
    assert {x.doc_id for x in got if x.keep} == set(want.label.tolist())


def altered(r, w, n, kind, fresh):
    """A copy of words ``w`` with about ``n`` shingles that aren't there."""
    v = list(w)
    if kind == "words":
        for _ in range(max(1, n // 5)):
            v[r.randrange(len(v))] = fresh()
    elif kind == "tail":
        v = v[: len(v) - n]
    elif kind == "block":
        at = r.randrange(max(1, len(v) - n))
        v[at : at + n] = [fresh() for _ in range(n)]
    else:
        v = [fresh() for _ in range(n)] + v
    return v


@pytest.mark.parametrize("natural", [False, True])
def test_near_recall(spark, natural):
    """Of pairs in each band of similarity 0.9 and more are found, by whatever edit and length."""
    r = random.Random(11)
    fresh = lambda: f"x{r.randrange(10**7)}"
    if natural:
        pool = sorted({x.text for x in common.read(spark, SF, "documents").collect() if x.text and len(x.text.split()) > 40})
        base = [pool[i % len(pool)].split()[: 40 + 29 * i % 400] + [f"own{i}"] for i in range(160)]
    else:
        base = [[f"w{r.randrange(10**6)}" for _ in range(20 + 13 * i % 500)] for i in range(160)]
    texts = []
    for i, w in enumerate(base):
        part = (0.03, 0.07, 0.09, 0.11)[i % 4]
        texts += [" ".join(w), " ".join(altered(r, w, max(1, int(part * len(w))), ("words", "tail", "block", "head")[i // 4 % 4], fresh))]
    sets = [set(zip(*(t.lower().split()[k:] for k in range(5)), strict=False)) for t in texts]
    got = {x.doc_id: x.group_id for x in simhash.near_duplicates(docs(spark, list(enumerate(texts)))).collect()}
    bands = defaultdict(list)
    for i in range(0, len(texts), 2):
        j = len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1])
        bands[min(int(j * 20), 19)].append(got[i] == got[i + 1])
    assert {16, 17, 18} <= set(bands)
    for band in (16, 17, 18, 19):
        assert np.mean(bands[band] or [1]) >= 0.9, (band, len(bands[band]))
    if not natural:
        assert not any(any(bands[b]) for b in bands if b < 16)


def test_near_groups_of_a_large_cluster(spark, monkeypatch):
    """A cluster of many blocks and what is near it without belonging to it."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    r = random.Random(12)
    w = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(150):
        v = list(w)
        for _ in range(1 + i % 3 if i % 10 else 6):  # some are below the threshold
            v[r.randrange(200)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(v))
    want = simhash.Forest(len(texts))
    want.link(*np.array(sorted(brute_near(texts))).T)
    least = {}
    got = simhash.near_duplicates(docs(spark, list(enumerate(texts)))).collect()
    for x in got:
        least[x.group_id] = min(x.doc_id, least.get(x.group_id, x.doc_id))
    assert {x.doc_id: least[x.group_id] for x in got} == dict(enumerate(want.label.tolist()))
    assert len(set(least.values())) > 1


def test_near_dedup_odd(spark):
    out = simhash.near_dedup(odd(spark))
    assert out.columns == odd(spark).columns
    # one of the wordless ones, one of the long ones, one of the repeated rows
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(["1", "4", "6", "None", "7", "8", "9"])
    assert simhash.near_dedup(docs(spark, [])).count() == 0


# --- 10 sharding ---

def test_hilbert_curve():
    for dims, bits in ((2, 3), (3, 4), (3, 2)):
        at = sharding.curve(dims, bits)
        assert sorted(at) == list(range(1 << dims * bits))
        side = (1 << bits) - 1
        cell = {i: [c >> bits * (dims - 1 - k) & side for k in range(dims)] for c, i in enumerate(at)}
        assert all(sum(abs(a - b) for a, b in zip(cell[i], cell[i + 1])) == 1 for i in range(len(at) - 1))


def check_shards(out, n):
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert sum(map(len, by.values())) == n and set(by) <= set(range(8))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1


def test_sharding(spark):
    d = common.read(spark, SF, "documents")
    out = sharding.shard(d).collect()
    check_shards(out, d.count())
    text = {r.doc_id: r.text for r in d.collect()}
    assert all(r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in out)
    order = sorted(out, key=lambda r: (r.shard, r.slot))
    assert [r.cell for r in order] == sorted(r.cell for r in order)


def test_sharding_odd(spark):
    out = sharding.shard(odd(spark)).collect()
    check_shards(out, 12)
    assert sorted(str(r.text_crc32) for r in out).count("None") == 2
    assert sharding.shard(docs(spark, [])).count() == 0
    kept = sharding.shard(odd(spark), keep=True)
    assert kept.count() == 12 and kept.columns == [c for c in odd(spark).columns if c != "shard"] + ["shard", "slot", "cell"]
    check_shards(sharding.shard(docs(spark, [(7, "same", "en", "a")] * 100)).collect(), 100)


def test_sharding_writes_shards(spark, monkeypatch, tmp_path):
    """A file lies in one shard and one run of slots, and holds few cells, sources and languages."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(sharding, "FILE_BYTES", 40_000)
    d = common.read(spark, SF, "documents")
    sharding.shard(d, keep=True).write.parquet(str(tmp_path / "shards"))
    d.repartition(8).write.parquet(str(tmp_path / "any"))
    files = [t for f in (tmp_path / "shards").glob("*.parquet") if len(t := pq.read_table(f).to_pandas())]
    assert len(files) > 8 and sum(map(len, files)) == d.count()
    for t in files:
        assert t["shard"].nunique() == 1 and t["slot"].tolist() == list(range(t["slot"].iloc[0], t["slot"].iloc[0] + len(t)))
        assert t["cell"].is_monotonic_increasing
    runs = sorted((t["cell"].min(), t["cell"].max()) for t in files)
    assert all(a[1] <= b[0] for a, b in zip(runs, runs[1:]))
    want = "src1"
    skipped = [not t["source"].min() <= want <= t["source"].max() for t in files]
    other = [pq.read_table(f).to_pandas()["source"] for f in (tmp_path / "any").glob("*.parquet")]
    assert np.mean(skipped) > 0.5 > 0.2 >= np.mean([not x.min() <= want <= x.max() for x in other if len(x)])
