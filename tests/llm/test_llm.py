"""The training-data operators against brute force, exact round trips and held-out accuracy, and on odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from graphloom.llm import chat, html_extract, jaccard_join, langid, packing, pii, quality
from graphloom.llm.decontaminate import decontaminate, leaks
from graphloom.llm.jaccard_join import jaccard_components, keep_one
from graphloom.llm.sharding import jump, shard_documents
from graphloom.llm.token_counts import count_tokens

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
PATH = public_tokenizers.path("word_bpe_49k.json")


def text(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


ROWS = [
    (1, text(1, 200)), (2, text(1, 200)), (3, text(1, 200) + " extra"), (4, text(2, 300)), (5, None), (6, ""), (7, "  \n\t"), (8, "One"), (9, "one"), (10, text(1, 199) + " changed"),
    (11, text(3, 5000)), (12, "mail a.b@c.de or +49 (30) 123-4567, card 4111 1111 1111 1111, host 10.0.0.255 and 999.1.1.1"), (13, "<|endoftext|> Größe 漢字 x1y2"), (None, text(4, 60)), (4, text(2, 300)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "cls", 0) for i, t in ROWS], "doc_id long, text string, lang string, source string, n long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_packing_is_a_round_trip(docs, empty):
    tok = Tokenizer.from_file(PATH)
    got = packing.pack(docs, PATH).collect()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in ROWS}
    spans, windows = {}, {}
    for r in got:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        spans.setdefault(r.doc_id, []).append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len([*tok.encode(t or "", add_special_tokens=False).ids, 1]) for _, t in ROWS)
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty, PATH).count() == 0


def test_differencing_keeps_everything():
    rng = np.random.default_rng(3)
    for n in (1, 7, 60):
        sizes = rng.integers(1, 512, n).tolist()
        dealt = packing.windows(sizes, 2048)
        assert sorted(i for w in dealt for i in w) == list(range(n)) and all(sum(sizes[i] for i in w) <= 2048 for w in dealt)


def test_token_counts(docs, empty):
    tok = Tokenizer.from_file(PATH)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, PATH).collect())
    want = sorted((i or 0, len((t or "").encode()), (n := len(tok.encode(t or "", add_special_tokens=False).ids)), n > 2048) for i, t in ROWS)
    assert got == want and count_tokens(empty, PATH).count() == 0


def brute(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: (len(s), label[i]) for i, s in sets.items()}


def test_jaccard_join(docs, empty):
    known = [r for r in ROWS if r[0] is not None]
    for width, num in ((4, 85), (5, 80)):
        got = jaccard_components(docs, width, num, 100).filter("doc_id is not null").collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(known, width, num, 100)
    kept = keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8, 11, 12, 13]
    assert jaccard_components(empty).count() == 0


@pytest.mark.parametrize("cell", [2048, 8])
def test_links_inside_components_count(spark, monkeypatch, cell):
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    base = [f"w{k}" for k in range(200)]
    edited = lambda k, n, step=1: " ".join(f"{w}x{k}" if i in range(k * step, k * step + n) else w for i, w in enumerate(base))
    texts = [edited(k, 1, 4) for k in range(40)] + [edited(k, 9) for k in range(1, 180, 11)] + ["v " * 90 + text(5, 80), *(text(6, 90) + f" {x}" for x in "abc")]
    rows = list(enumerate([*texts, texts[3], texts[3], texts[50]], 1))
    sets = {frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) for w in (t.split() for _, t in rows)}
    links = {s: sum(100 * len(s & o) >= 85 * len(s | o) for o in sets if o != s) for s in sets}
    want = {i: links[frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3))] for i, w in ((i, t.split()) for i, t in rows)}
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 85, 100).collect()
    assert {r.doc_id: r.n_links for r in got} == want and sorted(want.values())[0] == 0 and want[1] >= 39
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 4, 85, 100)


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, text(3, 5000).upper()[:400]), (2, text(9, 40)), (3, None), (4, "two words"), (5, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(docs, items).collect()} == {(11, 1)}
    assert 11 not in {r.doc_id for r in decontaminate(docs, items).collect()} and decontaminate(docs, items).count() == len(ROWS) - 1
    assert leaks(empty, items).count() == 0 and leaks(docs, items.limit(0)).count() == 0


def test_sharding(spark, docs, empty):
    got = shard_documents(docs, 16).collect()
    assert len(got) == len(ROWS) and all(r.grown_shard in (r.shard, 16) for r in got)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))

    def plain(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) & (2**64 - 1)
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    keys = spark.range(500).select(F.col("id"), jump(F.col("id"), 10).alias("s")).collect()
    assert all(r.s == plain(r.id, 10) for r in keys) and shard_documents(empty).count() == 0


def test_pii(docs, empty):
    got = {r.doc_id: r.spans for r in pii.find_pii(docs).collect()}
    t = dict(ROWS)[12]
    assert {(s.kind, t[s.start : s.end]) for s in got[12] if s.base} == {("email", "a.b@c.de"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 123-4567")}
    assert got[5] == got[6] == got[11] == [] and pii.find_pii(empty).count() == 0
    red = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert "4111" not in red[12] and "<card>" in red[12] and red[5] is None and red[11] == dict(ROWS)[11]


def test_redaction_of_overlapping_spans(spark, monkeypatch):
    t = "at 10.0.0.0 4111 1111 1111 1111 end"
    spans = [("ip", 3, 11, True), ("card", 9, 31, True), ("phone", 12, 16, True)]

    class Frame:  # redact's own loop, fed with spans that overlap
        sparkSession, columns, schema = spark, ["text"], None

        def mapInArrow(self, run, _):
            return [x.column(0).to_pylist() for x in run([pa.record_batch([pa.array([t])], names=["text"])])]

    monkeypatch.setattr(pii, "find", lambda texts, _: [spans for _ in texts])
    assert pii.redact(Frame(), object.__new__(pii.Field)) == [["at <ip> end"]]


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    got = langid.identify(d, ~held).filter(held).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.97 * len(got)


def test_language_odd_rows(docs, empty):
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    assert got[5] == got[6] == got[7] == ("und", 0.0) and got[1][0] == "en" and langid.identify(empty).count() == 0


def test_html(spark):
    field = html_extract.fit(html_extract.labelled_pages())
    ex = html_extract.Extractor(field)
    held = html_extract.labelled_pages(150, 77)
    right = sum(a == b for p in held for b, a in zip(html_extract.blocks(p)[2], ex.labels(html_extract.blocks(p)[1]), strict=True))
    assert right > 0.99 * sum(len(html_extract.blocks(p)[2]) for p in held)
    page = "<nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1><p>One  two&nbsp;<b>three</b>,\nfour.<p>Five six seven, &lt;b&gt; eight.<script>x('</p>')</script></article><footer>&copy; x</footer>"
    df = spark.createDataFrame([(1, "u", page, "old"), (2, "u", None, "old"), (3, "u", "", "old"), (4, "u", "<<< & <p", "old")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(df, field).collect()}
    want = "A & B One two three, four. Five six seven, <b> eight."
    assert got[1] == (want, len(want)) and got[2] == got[3] == ("", 0) and html_extract.extract(df.limit(0), field).count() == 0


def test_chat(spark):
    c = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    held = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 == 2
    model = chat.learn(c.filter(~held))
    got = chat.format_chats(c, model).toPandas()
    want = c.toPandas().merge(got, on=["conv_id", "turn"], suffixes=("", "_got"))
    assert len(got) == c.count() and (want.text == want.text_got).all() and (want.role == want.role_given).all()
    of_held = want[want.conv_id.map(lambda x: zlib.crc32(str(x).encode()) % 4 == 2)]
    assert (of_held.role == of_held.role_got).mean() > 0.95 and got.rendered[0] == f"<|{got.role[0]}|>\n{got.text[0]}\n<|end|>\n"
    # the role column is no input of a prediction, and blocks don't change results
    key = ["conv_id", "turn", "part"]
    blind = chat.format_chats(c.withColumn("role", F.lit(None).cast("string")), model).toPandas().sort_values(key).reset_index(drop=True)
    pieces = chat.format_chats(c, model, blocks=37).toPandas().sort_values(key).reset_index(drop=True)
    got = got.sort_values(key).reset_index(drop=True)
    assert got.role.equals(blind.role) and got.equals(pieces)
    # brute force: one pass over all lines of each conversation
    rows = sorted(map(tuple, c.select("conv_id", "turn", "role", "text").collect()))
    plain = {r[:3]: r[3] for conv in {r[0] for r in rows} for r in chat._decoded([x for x in rows if x[0] == conv], model)}
    assert all(plain[tuple(r[:3])] == r[3] for r in got[[*key, "role"]].itertuples(index=False))


def test_chat_transcripts_and_odd_rows(spark):
    model = chat.learn(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    odd = spark.createDataFrame(
        [(None, 1, "user", "x"), (None, 1, "user", "x"), (1, None, None, None), (2, 0, None, "User: hi\nAssistant: hello\nthere\nUser: bye"), *[(3, 5, "user", f"turn {i}") for i in range(40)]], "conv_id long, turn long, role string, text string"
    )
    for blocks in (None, 7):
        rows = chat.format_chats(odd, model, blocks).collect()
        assert [(r.role, r.text) for r in sorted((r for r in rows if r.conv_id == 2), key=lambda r: r.part)] == [("user", "hi"), ("assistant", "hello\nthere"), ("user", "bye")]
        assert len(rows) == 45 and sum(r.conv_id == 3 for r in rows) == 40
    assert chat.format_chats(odd.limit(0), model).count() == 0


def test_quality(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in quality.judge(d).collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    judged = [(r.quality, got[r.doc_id].kept) for r in labels if not got[r.doc_id].base_failed]
    assert all(k for q, k in judged if q == 1) and np.mean([not k for q, k in judged if q == 0]) > 0.9
    for r in d.limit(200).collect():
        w = re.findall(r"[^\x20\x09-\x0d]+", r.text)
        seen: dict = {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        cover = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
        lines = [x for x in r.text.split("\n") if x.split()]
        m = got[r.doc_id]
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text), len(lines) - len(set(lines)), len(cover))
    assert quality.judge(docs).count() == len(ROWS) and quality.judge(empty).count() == 0


def test_quality_keeps_rare_languages(spark):
    greek = "άλφα βήτα γάμμα δέλτα έψιλον ζήτα ήτα θήτα ιώτα κάππα λάμδα μι νι ξι όμικρον πι ρο σίγμα ταυ ύψιλον φι χι ψι ωμέγα".split()
    russian = "азъ буки веди глаголь добро есть живете зело земля иже како люди мыслете наш он покой".split()
    of = lambda words, seed: " ".join(np.random.default_rng(seed).choice(words, 250))
    rows = [(i, text(i, 120), "en") for i in range(2995)] + [(3000 + i, of(greek, i), "el") for i in range(12)] + [(3100 + i, of(russian, i), "ru") for i in range(3)]
    rows += [(3200, "".join(chr(33 + (i * 37) % 90) + (" " if i % 7 == 0 else "") for i in range(1500)), "el"), (3201, text(1, 10), "ru")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert [r.lang for r in quality.references(d)] == ["el", "en"]
    kept = {r.doc_id: r.kept for r in quality.judge(d).collect()}
    assert all(k for i, k in kept.items() if i < 3200) and not kept[3200] and not kept[3201]


def test_pii_digest_query(spark):
    from graphloom.llm.queries import op4_pii

    r = op4_pii(spark, "/root/testdata/sf0.001").filter("n_email + n_ip + n_card + n_phone = 0").first()
    assert r.base_sha256 == hashlib.sha256(b"").hexdigest()
