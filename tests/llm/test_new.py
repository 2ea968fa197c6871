"""Resampling, fill-in-middle and SimHash beside brute force, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import fim, importance, queries, simhash

SF = "/root/testdata/sf0.001"
WORD11 = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "Café NIÑO straße 漢字 🙂 x1-2_3 <b>"), (6, "mark <P> inside"), (7, "a<P b>c <S x"), (8, "two words"), (9, "  lead and trail \n"), (10, "\x00nul \x0b vt\x1cfs\x85nel nbsp"),
    (11, "word " * 5000), (12, "same text here again and again"), (12, "same text here again and again"), (None, "no id at all, but words"), (None, None), (13, "same text here again and again"),
    *((20 + k, " ".join(f"w{(k * j) % 17}" for j in range(25 + k))) for k in range(12)),
]


def frame(spark, rows=ODD):
    """Extra columns have the names of the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("rank", F.lit("x")).withColumn("uid", F.lit(1)).withColumn("fp", F.lit(2)).withColumn("form", F.lit(None).cast("string")).withColumn("label", F.lit(0))


def oracle(name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in got.description]
    return Counter(tuple(r[names.index(c)] for c in sorted(names)) for r in got.fetchall())


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_fill_in_middle"])
def test_query_equals_its_sql(spark, name):
    got = queries.queries()[name](spark, SF)
    assert Counter(tuple(r[c] for c in sorted(got.columns)) for r in got.collect()) == oracle(name)


# --- resampling -------------------------------------------------------------


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_crcs_of_runs_are_composed():
    rng = np.random.default_rng(3)
    for width in (1, 2, 3, 5):
        listed = [bytes(rng.integers(97, 123, int(n)).astype(np.uint8)) for n in rng.integers(1, 90, 40)] + [b"x" * 70_000, b"y"]
        crc = np.array([zlib.crc32(w) for w in listed], np.uint32)
        got = np.concatenate(list(importance.combined(crc, np.array([len(w) for w in listed]), width)))
        assert got.tolist() == [zlib.crc32(b" ".join(listed[i : i + k])) for k in range(1, width + 1) for i in range(len(listed) - k + 1)]


def test_long_texts_are_hashed_in_parts(monkeypatch):
    raw = " ".join(f"w{k % 37}" for k in range(1000)).encode()
    whole = [Counter(np.concatenate(list(importance.features(raw, w)[1])).tolist()) for w in (1, 3)]
    monkeypatch.setattr(importance, "RUN", 64)
    assert [Counter(np.concatenate(list(importance.features(raw, w)[1])).tolist()) for w in (1, 3)] == whole


@pytest.mark.parametrize("width", [1, 2])
def test_resample_by_brute_force(spark, width):
    buckets, target = 50, ["w1 w2 w3", "w1 Same text", None, ""]

    def feats(text):
        ws = WORD11.findall(lowered(text))
        return len(ws), [zlib.crc32(" ".join(ws[i : i + k]).encode()) % buckets for k in range(1, width + 1) for i in range(len(ws) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in ODD:
        s.update(feats(text)[1])
    for text in target:
        t.update(feats(text)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(buckets)]
    want, fit = [], []
    for k, (doc, text) in enumerate(ODD):
        n, f = feats(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        want.append([doc, len(f), weight, score, None])
        if n >= 3:
            fit.append((-score, doc is None, doc or 0, k))
    for rank, (*_, k) in enumerate(sorted(fit)[: len(fit) * 40 // 100]):
        want[k][4] = rank + 1
    got = importance.resample(frame(spark), spark.createDataFrame([(x,) for x in target], "text string"), width, buckets, 3, 40).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def test_resample_of_nothing(spark):
    some, none = frame(spark), frame(spark).limit(0)
    assert importance.resample(none, some).count() == 0
    got = importance.resample(some, none, percent=100, least_words=0).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, len(ODD) + 1))
    assert all(r["rank"] is None for r in importance.resample(some, some, percent=0).collect())


# --- fill in middle ---------------------------------------------------------


def filled(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        form, out = "plain", text
    else:
        form, out = ("spm", f"<S>{suf}<P>{pre}<M>{mid}") if h[3] % 100 < 80 else ("psm", f"<P>{pre}<S>{suf}<M>{mid}")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc, len(units), form, None if form == "plain" else len(pre), None if form == "plain" else len(mid), out, sha(out), sha(text)


def test_fill_in_middle_by_brute_force(spark):
    odd = [(100 * k + (doc or 0), text) for k in range(40) for doc, text in ODD] + ODD  # many draws for each odd text
    got = fim.fill_in_middle(frame(spark, odd)).collect()
    assert Counter(map(tuple, got)) == Counter(filled(*r) for r in odd)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert Counter(map(tuple, fim.fill_in_middle(docs).collect())) == Counter(filled(r["doc_id"], r["text"]) for r in docs.collect())


def test_fill_in_middle_in_slices(spark, monkeypatch):
    import pyarrow as pa

    from graphloom.llm.common import by_bytes

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 5, None, "", "b" * 9, "c", "d"])], names=["text"])
    assert [s.num_rows for s in by_bytes(batch, 0, 6)] == [3, 1, 2] and pa.Table.from_batches(list(by_bytes(batch, 0, 1))).equals(pa.Table.from_batches([batch]))
    assert fim.fill_in_middle(frame(spark).limit(0)).count() == 0


# --- SimHash ----------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, most):
    """The least index that links reach, by all pairs."""
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(fps))]


def near_fingerprints(rng, groups, size, flips):
    out = []
    for _ in range(groups):
        x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(2))
        for _ in range(size):
            out.append(x)
            for b in rng.integers(0, 64, int(rng.integers(0, flips + 1))).tolist():
                x ^= 1 << b  # chains drift away from their start
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_forest_keeps_components(most):
    fps = near_fingerprints(np.random.default_rng(most), 12, 30, 4)
    links = simhash.forest(np.array(fps, np.uint64), most, simhash.pivots()).tolist()
    assert len(links) < len(fps) and all((a ^ b).bit_count() <= most for a, b in links)
    at = {x: i for i, x in enumerate(fps)}
    want = plain_components(fps, most)
    assert len(set(want)) == len(fps) - len(links) and all(want[at[a]] == want[at[b]] for a, b in links)


@pytest.mark.parametrize("cell", [8192, 6])
def test_links_across_cells(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    fps = near_fingerprints(np.random.default_rng(9), 20, 25, 3)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.linked(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    want, at = plain_components(fps, 2), {x: i for i, x in enumerate(signed)}
    up = {frozenset((at[r.a], at[r.b])) for r in links}
    assert all((fps[i] ^ fps[j]).bit_count() <= 2 for i, j in map(sorted, up))
    got = list(range(len(fps)))
    for _ in range(len(fps)):
        for i, j in map(sorted, up):
            got[i] = got[j] = min(got[i], got[j])
    assert got == want


@pytest.mark.parametrize("docs", ["odd", "table"])
def test_simhash_by_brute_force(spark, docs):
    rows = ODD if docs == "odd" else [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = plain_components(fps, 2)
    least = {}
    for (doc, _), c in zip(rows, comp, strict=True):
        if doc is not None:
            least[c] = min(doc, least.get(c, doc))
    want = Counter((doc, f"{fp:016x}", least.get(c)) for (doc, _), fp, c in zip(rows, fps, comp, strict=True))
    assert Counter(map(tuple, simhash.simhash_components(frame(spark, rows)).collect())) == want


def test_simhash_query_and_nothing(spark):
    assert queries.queries()["op13_simhash"](spark, SF).columns == ["doc_id", "fingerprint", "component_id"]
    assert simhash.simhash_components(frame(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.simhash_components(frame(spark), most=4)


def test_long_texts_are_fingerprinted_in_parts(monkeypatch):
    text = " ".join(f"w{k % 91}" for k in range(700))
    monkeypatch.setattr(simhash, "RUN", 64)
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


# --- personal data ----------------------------------------------------------


def test_marginals_on_a_tree_by_enumeration(monkeypatch):
    from itertools import product

    from graphloom.llm import pii

    rng = np.random.default_rng(4)
    k = len(pii.LABELS) + 1
    field = pii.Field(rng.normal(size=(len(pii.FEATURES), k)), rng.normal(size=(k, k)), rng.normal(size=(k, k)))
    x = (rng.random((5, len(pii.FEATURES))) < 0.1).astype(np.uint8)
    near, tied = np.array([(0, 1), (1, 2)]), np.array([(0, 3), (2, 4)])
    want = np.zeros((5, k))
    own = x @ field.weight
    for y in product(range(k), repeat=5):
        s = sum(own[i, y[i]] for i in range(5)) + sum(field.near[y[a], y[b]] for a, b in near) + sum(field.tied[y[a], y[b]] for a, b in tied)
        for i in range(5):
            want[i, y[i]] += math.exp(s)
    want /= want.sum(1, keepdims=True)
    monkeypatch.setattr(pii, "ROUNDS", 60)
    for step in (1 << 15, 2):
        monkeypatch.setattr(pii, "STEP", step)
        assert np.allclose(pii.marginals(field, x, near, tied), want, atol=1e-6)


def test_zeros_and_marks_behind_long_runs(spark):
    from graphloom.llm import pii

    zeros = "0" * 5000
    assert pii.base_spans(f"a {zeros}1.2.3.{zeros} b") == [("ip", 2, 10008)] and pii.base_spans(f"{zeros}256.2.3.4") == []
    for run in ("1,jo.berg[at]mail.example.com", ";" * 450 + "1,jo.berg[at]mail.example.com", "a1" * 5000 + "(at)mail.example.com", "jo1 @ mail.example.com"):
        assert pii._disguised(run)
    assert not any(map(pii._disguised, ("[at]mail.example.com1", "a" * 100_000 + "1", "a@" * 50_000, "jo@home24", "(at)(at)1")))
    text = " ".join(str(j % 7) for j in range(40_000)) + f" {zeros}1.2.3.4"  # one token after another
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_pii(rows, pii.fit([])).collect()}
    assert [s.kind for s in got[1] if s.base] == ["ip"] and got[2] == got[3] == []


def test_all_mentions_are_tied():
    from graphloom.llm import pii

    at, _, _, ties = pii.describe("call 415 555 0123 4 now, later 4155550123 and then 4155550123 and at last 4155550123")
    numbers = [i for i, (a, b) in enumerate(at) if b - a == 10]
    assert {(numbers[0], numbers[1]), (numbers[0], numbers[2]), (numbers[1], numbers[2])} <= set(ties)


# --- HTML -------------------------------------------------------------------

PROSE = ["The river rose for three days, and nobody in the village could remember such a flood.", "By noon the square was empty. Only the baker had opened his shop, as he did every morning.", "Nobody knew how long the water would stay, but the old bridge held."]
MENU = "<a href='/a'>Start</a> <a href='/b'>About us</a> <a href='/c'>Shop</a>"
LAYOUTS = {
    "bare": "<html><body><p>{0}</p><p>{1}</p><p>{2}</p></body></html>",
    "bare with a title": "<body><h1>A flood</h1><p>{0}</p><p>{1}</p><p>{2}</p></body>",
    "bare beside parts": f"<body><nav>{MENU}</nav><h1>A flood</h1><p>{{0}}</p><p>{{1}}</p><p>{{2}}</p><footer>&copy; 2024 About us</footer></body>",
    "cell": f"<body><table><tr><td><ul><li><a href='/a'>Start</a></li><li><a href='/b'>About us</a></li></ul></td><td><p>{{0}}</p><p>{{1}}</p><p>{{2}}</p></td></tr></table></body>",
    "cell in rows": f"<body><table><tr><td colspan=2>{MENU}</td></tr><tr><td>{MENU}</td><td><h2>A flood</h2><p>{{0}}</p><p>{{1}}</p><p>{{2}}</p></td></tr></table></body>",
    "nameless": f"<body><div><div>{MENU}</div></div><div><div><h1>A flood</h1><p>{{0}}</p><p>{{1}}</p><p>{{2}}</p></div></div><div>&copy; 2024</div></body>",
    "odd names": f"<body><div class='qx1'>{MENU}</div><div class='zz9'><h1>A flood</h1><p>{{0}}</p><p>{{1}}</p><p>{{2}}</p></div><div class='vv3'>&copy; 2024 About us</div></body>",
}


def test_articles_of_layouts_without_names():
    from graphloom.llm import html_extract

    ex = html_extract.Extractor(html_extract.fit(html_extract.labelled_pages()))
    for name, layout in LAYOUTS.items():
        got = ex.text(layout.format(*PROSE))
        assert all(p in got for p in PROSE) and "About" not in got and "2024" not in got, (name, got)
    got = ex.text("<body><article><p>Take <math><mi>x</mi><mo>+</mo><mn>1</mn></math> and <object>a drawing</object>, then go on with it as before.</p></article></body>")
    assert got == "Take x + 1 and a drawing , then go on with it as before."
