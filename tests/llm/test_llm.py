"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import base64
import gzip
import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from compare import assert_same, connect
from pyspark.sql import functions as F

from edgeloom.llm import bpe, chat, common, components, exact_dedup, langid, media, mixing, queries, sharding, simhash, toxicity, warc

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, kept boolean, block int, score double, rank int, fp string"

LONG = "word number one and two, " * 60_000  # 1.5 MB
ROWS = [
    (1, "Hello big wide world, again and again", "en"), (2, "hello  big wide world,\tagain and again", "en"), (3, None, "en"), (4, "", None), (5, " \n\t ", "fr"),
    (6, LONG, "en"), (7, "Ünïcode ẞ 日本語 😀", None), (8, "12345 !!! 678", "de"), (9, "Hello big wide world, again and again", "en"),
    (9, "Hello big wide world, again and again", "en"), (None, "Hello big wide world, again and again", None), (10, "x", "de"), (11, "a" * 5000, "fr"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, [None, "s1", "s2"][k % 3], None, 7, 1.5, 3, "ff") for k, (i, t, lang) in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()]
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hs) > len(hs))


def brute_components(ids, prints, radius):
    parent = list(range(len(ids)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    assert_same(spark, FOLDER, queries.queries()[name], queries.oracle_sql()[name])


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert exact_dedup.exact_groups(none).count() == 0
    assert simhash.near_groups(none).count() == 0
    assert langid.predict(none, langid.fit(none)).count() == 0
    assert toxicity.score(none, np.zeros(toxicity.DIMS + 1, dtype=np.float32)).count() == 0
    assert media.text_media(none).count() == 0
    assert sharding.assign(none).count() == 0
    assert mixing.mixture(none).count() == 0
    assert bpe.encode_documents(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_exact_dedup(odd):
    rows = exact_dedup.exact_groups(odd).collect()
    assert len(rows) == len(ROWS)
    strip = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    for r in rows:
        text = next(t for i, t, _ in ROWS if i == r.doc_id)
        same = [(-len(t or ""), i is None, i) for i, t, _ in ROWS if strip(t) == strip(text)]
        assert r.keep_id == min(same)[2] and r.group_size == len(same) and (not r.kept or r.doc_id == r.keep_id)
        assert r.text_sha256 == hashlib.sha256(strip(text).encode()).hexdigest()
    kept = Counter(r.text_sha256 for r in rows if r.kept)
    assert set(kept) == {r.text_sha256 for r in rows} and set(kept.values()) == {1}


@pytest.mark.parametrize("support", [0.3, 1 / 1024])
def test_repeated_rows_leave_one(spark, support):
    rows = [(1, "a b c")] * 3 + [(2, "a b c"), (1, "abc"), (3, "x"), (None, "y"), (None, "y")]
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id bigint, text string, __row string")
    got = exact_dedup.exact_groups(docs, support).collect()
    assert len(got) == len(rows) and Counter((r.doc_id, r.group_size) for r in got if r.kept) == Counter([(1, 5), (3, 1), (None, 2)])
    assert Counter((r.doc_id, r.text) for r in exact_dedup.drop_copies(docs, support).collect()) == Counter([(1, "a b c"), (3, "x"), (None, "y")])
    assert Counter((r.doc_id, r.text) for r in simhash.drop_near_copies(docs).collect()) == Counter([(1, "a b c"), (1, "abc"), (3, "x"), (None, "y")])


def test_many_keys_are_filtered_before_the_join(spark, monkeypatch):
    monkeypatch.setattr(common.checked_broadcast, "__defaults__", (3,))
    rows = [(i % 50 or None, f"t{i % 120}", i) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __key0 int")
    keys = docs.filter("__key0 % 7 = 0").select("doc_id", "text")
    gone = {(r.doc_id, r.text) for r in keys.collect()}
    own = [F.col("doc_id"), F.col("text")]
    got = common.without(docs, own, keys)
    assert got.columns == docs.columns and Counter(tuple(r) for r in got.collect()) == Counter(r for r in rows if r[:2] not in gone)
    one = common.one_each(docs, own, keys).collect()
    assert Counter((r.doc_id, r.text) for r in one if (r.doc_id, r.text) in gone) == Counter(gone) and len(one) == len(gone) + got.count()


@pytest.mark.parametrize("support", [0.9, 1 / 3, 1 / 1024])
def test_heavy_digests_do_not_change_the_result(spark, support):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same  text").otherwise(F.concat(F.lit("t"), (F.col("id") % 50).cast("string"))).alias("text"))
    rows = exact_dedup.exact_groups(docs, support).collect()
    assert len(rows) == 600 and sum(r.kept for r in rows) == 51
    assert {r.keep_id for r in rows if r.doc_id % 3 == 0} == {0} and {r.group_size for r in rows if r.doc_id % 3 == 0} == {200}
    assert exact_dedup.drop_copies(docs.withColumn("kept", F.lit("x")), support).count() == 51


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(500 + i, 501 + i) for i in range(120)] + [(900, 901 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in parent if find(i) != i}


def test_simhash_against_brute_force(spark, odd):
    rows = simhash.near_groups(odd).collect()
    prints = [brute_fingerprint(t) for _, t, _ in ROWS]
    want = Counter(zip([i for i, *_ in ROWS], [f"{p:016x}" for p in prints], brute_components([i for i, *_ in ROWS], prints, 2)))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == want


def test_simhash_whole_table(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    prints = [brute_fingerprint(t) for _, t in docs]
    want = dict(zip([i for i, _ in docs], zip([f"{p:016x}" for p in prints], brute_components([i for i, _ in docs], prints, 2))))
    rows = queries.op6_simhash(spark, FOLDER).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == want


def test_tiles_and_blocks_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 12).tolist()
    prints = sorted({b ^ sum(1 << int(k) for k in set(rng.integers(0, 64, n).tolist())) for b in base for n in (0, 1, 2, 3) for _ in range(40)})
    want = brute_components(prints, prints, 2)
    table = spark.createDataFrame([(p.to_bytes(8, "big"), p.bit_count(), []) for p in prints], "fp binary, ones int, anchors array<bigint>")
    for block_rows in (4096, 16):  # the second deals every block out as tile pairs
        tree = components.components(simhash.links(table, 64, 2, block_rows=block_rows)).collect()
        root = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in tree}
        assert [root.get(p, p) for p in prints] == want
    wide = np.array(prints, dtype=np.uint64).reshape(-1, 1)
    found = simhash.tile_links(wide, np.bitwise_count(wide[:, 0]).astype(int), 2, tile=32)
    assert all((prints[i] ^ prints[j]).bit_count() <= 2 for i, j in found) and len(found) == len(prints) - len(set(want))


def test_slices_of_long_texts_change_nothing(monkeypatch):
    text = ("Some words " + "x" * 50 + "\n") * 300
    whole = simhash.fingerprint(text.encode(), 5, 512, 4)
    monkeypatch.setattr(simhash, "SLICE", 97)
    assert simhash.fingerprint(text.encode(), 5, 512, 4) == whole
    grams = lambda: sorted(np.concatenate(list(langid.ngrams(text))).tolist())
    first = grams()
    monkeypatch.setattr(langid, "CHUNK", 101)
    assert grams() == first
    before = toxicity.features(text + "one two three four", {}).tolist()
    monkeypatch.setattr(toxicity, "_PIECE", 3)
    assert toxicity.features(text + "one two three four", {}).tolist() == before


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    texts = [[word() for _ in range(200)] for _ in range(30)]
    copies = [[w if k not in (50, 120) else "changed" for k, w in enumerate(t)] for t in texts[:10]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts + copies)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == list(range(30))


def test_a_family_below_the_similarity_stays(spark):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    template, texts = [word() for _ in range(170)], []
    for own in (30, 40):  # two families at about 0.73 and 0.67, each with two copies that differ in a word
        family = [template + [word() for _ in range(own)] for _ in range(40)]
        texts += family + [["changed", *t[1:]] for t in family[:2]]
        template = [word() for _ in range(170)]
    sets = [set(simhash.shingle_set(" ".join(t).encode(), 5).tolist()) for t in texts]
    jaccard = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert 0.6 < jaccard(44, 45) < jaccard(2, 3) < 0.75 and jaccard(0, 40) > 0.8
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    want = [i for i in range(len(texts)) if i not in (40, 41, 82, 83)]
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == want


def test_repeated_lines_and_short_texts_are_near_copies(spark):
    rng = np.random.default_rng(13)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    rows = []
    for k in range(20):
        line, rest, short = [word() for _ in range(14)], [word() for _ in range(250)], [word() for _ in range(9)]
        rows += [(4 * k, line + rest), (4 * k + 1, line * 31 + rest), (4 * k + 2, short), (4 * k + 3, short[:8])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == list(range(0, 80, 2))


def test_rows_of_an_id_are_judged_by_their_own_group(spark):
    rng = np.random.default_rng(14)
    text = lambda: ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(100)]
    x, y, z = text(), text(), text()
    rows = [(3, x), (5, ["changed", *x[1:]]), (5, y), (9, ["changed", *y[1:]]), (9, z), (None, x)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id bigint, text string")
    got = Counter((r.doc_id, r.text) for r in simhash.drop_near_copies(docs).collect())
    assert got == Counter((i, " ".join(t)) for i, t in (rows[0], rows[2], rows[4]))


@pytest.mark.parametrize("block_rows", [4096, 8])
def test_near_copies_of_a_whole_table(spark, block_rows):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    sets = [set(simhash.shingle_set(t.encode(), 5).tolist()) for _, t in rows]
    holders, parent = {}, list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, own in enumerate(sets):  # every pair that shares a shingle, and the empty ones
        shared = Counter(j for x in own or [None] for j in holders.get(x, ()))
        for j, n in shared.items():
            if not own or n + 1e-9 >= 0.8 * (len(own) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for x in own or [None]:
            holders.setdefault(x, []).append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    got = sorted(r.doc_id for r in simhash.drop_near_copies(docs, block_rows=block_rows).collect())
    assert got == sorted(least.values())


def test_cells_and_tiles_lose_no_copy(spark):
    rng = np.random.default_rng(12)
    common = [str(k) for k in range(60)]
    texts = [common[: int(rng.integers(20, 60))] + [f"w{g}x{k}" for k in range(int(rng.integers(15, 90)))] for g in range(40)]
    texts += [t + ["more"] * int(rng.integers(1, 4)) for t in texts for _ in range(3)]
    sets = [set(simhash.shingle_set(" ".join(t).encode(), 5).tolist()) for t in texts]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    prints = simhash.profiles(docs, **simhash.WIDE).cache()
    node = {r.doc_id: r.node for r in prints.collect()}
    parent = {n: n for n in node.values()}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[max(find(node[i]), find(node[j]))] = min(find(node[i]), find(node[j]))
    for block_rows in (4096, 16):  # the second cuts blocks by size and deals them out
        tree = {r.node: r.root for r in components.components(simhash.copy_links(docs, prints, 0.8, 512, 5, block_rows)).collect()}
        assert {n: tree.get(n, n) for n in parent} == {n: find(n) for n in parent}


def test_language_id(spark, odd):
    held = queries.op3_language_id(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    rows = langid.predict(odd, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {3, 4, 5, 8}
    text = docs.first().text
    want = sum(model.logp[b].sum(axis=0) for b in langid.ngrams(text)) + model.prior
    assert langid._totals([text, "x", text], model)[2] + model.prior == pytest.approx(want)
    assert sorted(r.doc_id or 0 for r in langid.keep_identified(odd, model).collect()).count(3) == 0


def brute_ngrams(text, buckets):
    """Buckets of all 1- to 3-grams, a character at a time, with Python's integers."""
    c = [32] + [ord(x) if ord(x) > 127 or x.isalpha() else 32 for x in text.lower()]
    out = []
    for end in range(len(c)):
        for n in (1, 2, 3):
            if end - n + 1 >= 0:
                code = 0
                for k in range(1, n + 1):  # the last character is added last, with the order
                    code = (code * 0x100000001B3 + c[end - n + k] + k) % (1 << 64)
                out.append((code * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - buckets.bit_length() + 1))
    return out


def test_language_model_against_brute_force(spark, monkeypatch):
    assert Counter(np.concatenate(list(langid.ngrams("Ab İ1é😀ΑΣ"))).tolist()) == Counter(brute_ngrams("Ab İ1é😀ΑΣ", langid.BUCKETS))
    monkeypatch.setattr(langid, "CHUNK", 3)
    assert Counter(np.concatenate(list(langid.ngrams("Ab İ1é😀ΑΣ"))).tolist()) == Counter(brute_ngrams("Ab İ1é😀ΑΣ", langid.BUCKETS))
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (2, "der hund und die katze", "de"), (3, "le chat", "fr"), (4, None, "fr"), (5, "zzz", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    learnt = [(t, l) for _, t, l in rows if t and l]
    counts = {l: Counter(b for t, x in learnt if x == l for b in brute_ngrams(t, langid.BUCKETS)) for l in ("de", "en", "fr")}
    for text in ("the hund", "chat le", "und", "cat cat katze"):
        want = []
        for l in ("de", "en", "fr"):
            total = sum(counts[l].values()) + 0.5 * langid.BUCKETS
            want.append(math.log(sum(x == l for _, x in learnt) / len(learnt)) + sum(math.log((counts[l][b] + 0.5) / total) for b in brute_ngrams(text, langid.BUCKETS)))
        row = langid.predict(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), model).first()
        best = max(range(3), key=lambda i: want[i])
        assert row.lang_pred == ("de", "en", "fr")[best] and row.score == pytest.approx(1 / sum(math.exp(w - want[best]) for w in want))


def test_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 3)
    monkeypatch.setattr(langid, "MATRIX_BYTES", 3 * 8 * 1024)
    docs = spark.createDataFrame([(i, f"words of x{i % 5}", f"l{i % 5}") for i in range(23)], "doc_id bigint, text string, lang string")
    model = langid.fit(docs)  # l0, l1, l2 have five rows each, l3 and l4 four
    assert model.langs == ["l0", "l1", "l2"] and model.logp.shape == (1024, 3)
    assert {r.lang_pred for r in langid.predict(docs, model).collect()} <= set(model.langs)


def test_archives_from_files(spark, tmp_path):
    import io
    import json

    raw = [warc.make_record(i, f"http://x/{i}", b"payload %d " % i * (i + 1)) for i in range(40)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.warc.gz").write_bytes(gzip.compress(b"".join(raw)))
    (tmp_path / "in" / "two.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in raw[:5]))
    archives = warc.read_archives(spark, str(tmp_path / "in" / "*.warc.gz"))
    normal = warc.normalise(archives, part_bytes=2000).cache()
    names = sorted(r.archive for r in normal.collect())
    assert names[0] == "one" and "one-00001" in names and names[-1] == "two"
    got = Counter((r.page_id, r.payload) for r in warc.read_records(normal, payloads=True).collect())
    assert got == Counter([(i, b"payload %d " % i * (i + 1)) for i in [*range(40), *range(5)]])
    out, side = io.BytesIO(), io.BytesIO()
    assert warc.normalise_file(io.BytesIO((tmp_path / "in" / "one.warc.gz").read_bytes()), out, side) == 40
    index = [json.loads(x) for x in side.getvalue().decode().splitlines()]
    assert [gzip.decompress(out.getvalue()[x["offset"] : x["offset"] + x["length"]]) for x in index] == raw
    with pytest.raises(ValueError):
        warc.normalise_bytes(gzip.compress(b"".join(raw))[:-20])
    assert warc.normalise_bytes(gzip.compress(b"")) == (b"", [])
    warc.export(normal, str(tmp_path))
    assert gzip.decompress(b"".join((tmp_path / f"{n}.warc.gz").read_bytes() for n in names if n.startswith("one"))) == b"".join(raw)


def test_warc(spark):
    pages = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nEvil: 1", "<p>x</p>"), (5, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (6, "u", "ä" * 300_000), (7, "u", "WARC/1.1\r\n\r\nContent-Length: 5"), (7, "u", "other"), (None, "u", "<p>x</p>"), (None, "u", "alone")]
    t = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, original string")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(t).collect())
    body = [(p or "").encode() for *_, p in pages]
    want = Counter()
    for (i, *_), b in zip(pages, body):
        best = max((j for (j, *_), c in zip(pages, body) if c == b and j is not None), default=None)
        other = best if best is not None and best != i else None
        want[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if other is not None else "response", other)] += 1
    assert got == want
    raw = [warc.make_record(i, "http://x/", b"payload %d" % i) for i in range(50)]
    data, index = warc.normalise_bytes(gzip.compress(b"".join(raw)))
    assert [gzip.decompress(data[a : a + n]) for a, n, _ in index] == raw and gzip.decompress(data) == b"".join(raw)
    assert warc.normalise_bytes(data) == (data, index)  # already normal
    with pytest.raises(ValueError):
        warc.normalise_bytes(gzip.compress(b"".join(raw)[:-5]))
    archives = warc.normalise(warc.write_monolithic(warc.with_originals(t)))
    assert warc.sidecar(archives).count() == len(pages)


def test_toxicity(spark, odd):
    words = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(rng.choice(words, 40)) + (" you utter moron" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    labels = docs.select("doc_id", "toxic").filter(~toxicity.held_out())
    w = toxicity.fit(toxicity.labelled_sample(docs.drop("toxic"), labels))
    got = toxicity.score(docs, w).join(docs.select("doc_id", "toxic"), "doc_id").filter(toxicity.held_out()).collect()
    assert all(r.predicted == r.toxic for r in got) and np.count_nonzero(w) < 2000
    rows = toxicity.score(odd, w).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    bias = 1 / (1 + math.exp(-float(w[-1])))
    assert all(r.score == pytest.approx(bias) for r in rows if r.doc_id in (3, 4, 5))


def test_online_learning_against_plain_python(spark):
    rng = np.random.default_rng(17)
    rows = [(np.unique(rng.integers(0, 30, 6)), int(rng.integers(2))) for _ in range(60)]
    z, n = Counter(), Counter()

    def weight(i, l1=2.0):
        l1 = 0 if i == toxicity.DIMS else l1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((1 + math.sqrt(n[i])) / 0.5)

    for _ in range(3):
        for features, y in rows:
            every = [*features.tolist(), toxicity.DIMS]
            w = {i: weight(i) for i in every}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in every:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5 * w[i]
                n[i] += g * g
    got = toxicity.learnt(rows, 0.5, 2.0, 3)
    assert [got[i] for i in (*range(30), toxicity.DIMS)] == pytest.approx([weight(i) for i in (*range(30), toxicity.DIMS)])
    assert np.count_nonzero(got) <= 31


def test_calibration():
    rng = np.random.default_rng(18)
    s = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2.5 * s - 1)))).astype(int)
    slope, shift = toxicity.calibration(s, y)
    assert abs(slope - 2.5) < 0.3 and abs(shift + 1) < 0.3
    assert toxicity.calibration(s, np.zeros(4000)) == (1.0, 0.0) == toxicity.calibration(s[:0], y[:0])
    assert toxicity.calibration(np.array([-5.0, 5.0]), np.array([1, 0])) == (1.0, 0.0)  # never turned round


def test_repeated_labels_do_not_thin_the_sample(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(0).alias("toxic"))
    many = labels.crossJoin(spark.range(50).select(F.lit(1))).select("doc_id", "toxic")
    assert toxicity.labelled_sample(docs, many, 200).count() == 200
    assert toxicity.labelled_sample(docs, many.withColumn("toxic", F.lit(None).cast("int")), 200).count() == 0


def test_media(odd):
    rows = media.text_media(odd).collect()
    text = {i: (t or "").encode() for i, t, _ in ROWS}
    for r in rows:
        raw = text[r.doc_id]
        padded = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(padded), zlib.crc32(padded[-32:]))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
    assert len({r.feature for r in rows if r.doc_id in (1, 9)}) == 1
    rng = np.random.default_rng(8)
    grey, colour = rng.integers(0, 256, (37, 53), dtype=np.uint8), rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    for p in (grey, colour):
        assert (media.decode(media.encode_netpbm(p)) == p).all() and (media.decode(media.encode_bmp(p)) == p).all()
    assert media.decode(b"P2\n# note\n2 1\n255\n7 9\n").tolist() == [[7, 9]]
    assert media.decode(b"P1\n2 2\n1 0\n0 1\n").tolist() == [[0, 255], [255, 0]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    big = np.kron(grey.astype(float), np.ones((4, 4)))
    want = big.reshape(4, 37, 53, 4).mean(axis=(1, 2)) if False else np.array([[np.kron(grey, np.ones((4, 4)))[y * 37 : (y + 1) * 37, x * 53 : (x + 1) * 53].mean() for x in range(4)] for y in range(4)])
    assert media.area_resize(grey, 4, 4) == pytest.approx(want)


def test_media_tiles(spark):
    p = np.arange(64, dtype=np.uint8).reshape(8, 8)
    rows = {r.id: r for r in media.tiles(spark.createDataFrame([(1, media.encode_bmp(p)), (2, b"junk"), (3, None)], "id bigint, image binary"), side=4).collect()}
    import io

    assert np.load(io.BytesIO(rows[1].tile)).shape == (4, 4) and rows[2].tile is None and rows[3].dhash is None


def test_sharding(odd, spark):
    for docs, n in ((odd, len(ROWS)), (spark.read.parquet(f"{FOLDER}/documents.parquet"), 200)):
        rows = sharding.assign(docs).collect()
        sizes = Counter(r.shard for r in rows)
        assert len(rows) == n and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) <= set(range(8))
        for s in sizes:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
        order = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
        assert order == sorted(order)
    assert {r.text_crc32 for r in sharding.assign(odd).filter("doc_id = 7").collect()} == {zlib.crc32(ROWS[6][1].encode())}
    cells = sorted((i, c) for c, i in sharding.curve_table(3))
    assert [i for i, _ in cells] == list(range(4096))
    at = lambda c: np.array([c >> 8, c >> 4 & 15, c & 15])
    assert all(np.abs(at(a) - at(b)).sum() == 1 for (_, a), (_, b) in zip(cells, cells[1:]))


def test_shards_hold_every_row_once(spark, tmp_path):
    rows = [(i, f"text {k}", "en", "s", k, "own") for k, i in enumerate([None, None, 1, 1, 1, 2, 3, 4])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, slot int, shard string")
    sharding.write_shards(docs, str(tmp_path / "out"), 3)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(tuple(r) for r in got.select(*docs.columns).collect()) == Counter(rows)
    sizes = Counter(r.shard_ for r in got.collect())
    assert set(sizes) == {0, 1, 2} and max(sizes.values()) - min(sizes.values()) <= 1


def test_many_copies_of_a_row_are_sharded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 4)
    rows = [(7, "same", "en", "s")] * 41 + [(i, f"t{i}", "en", "s") for i in range(9)] + [(None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = sharding.assign(docs, 5).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for s in range(5):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own))) and len(own) in (10, 11)
    sharding.write_shards(docs, str(tmp_path / "out"), 5)
    assert Counter(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*docs.columns).collect()) == Counter(rows)


def test_columns_with_clashing_names(spark):
    rows = [(i, f"some words {i}", "en", "s", i, i, i, i) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, __s int, row int, block int, pass int")
    assert Counter(map(tuple, mixing.mixed(docs).collect())) == Counter(rows)
    assert Counter(map(tuple, exact_dedup.drop_copies(docs).collect())) == Counter(rows)
    assert Counter(map(tuple, simhash.drop_near_copies(docs.withColumnsRenamed({"block": "node", "pass": "component_id"})).collect())) == Counter(rows)
    with pytest.raises(ValueError):
        bpe.encode_documents(docs.withColumn("ids", F.lit(1)), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, keep=["ids"])


def test_mixing_to_a_budget(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d e").alias("text"), F.when(F.col("id") < 3000, "big").otherwise("small").alias("source"))
    for budget in (5000, 60000):
        got = {r.source: r.t for r in mixing.mixture(docs, budget=budget).groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
        assert 0.9 * budget <= sum(got.values()) <= budget and got["small"] / sum(got.values()) > 0.28


def test_mixing(spark, odd):
    got = mixing.mixture(odd).filter("pass = 0")
    assert got.count() == len(ROWS)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d e").alias("text"), F.when(F.col("id") < 3000, "big").when(F.col("id") < 3900, "mid").otherwise(None).alias("source"), F.lit(1).alias("block"))
    rows = mixing.mixture(docs).groupBy("source").agg(F.sum("tokens").alias("t"), F.count_distinct("doc_id").alias("n")).collect()
    by = {r.source: r for r in rows}
    assert by["big"].n == 3000 and by["big"].t == 15000 and by[None].n == 100
    assert 0.95 * 2 <= by[None].t / 500 <= 2 and by["mid"].t / 4500 < 2
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.exponent(spark.createDataFrame([("a", 5)], "source string, tokens bigint")) == 1.0


def test_bpe_against_tiktoken(spark, odd):
    import tiktoken

    tokens = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    for part in (docs, odd.filter("doc_id <> 9")):
        text = {r.doc_id: r.text or "" for r in part.collect()}
        rows = bpe.encode_documents(part, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, ids=True).collect()
        assert len(rows) == len(text)
        for r in rows:
            ids = own.encode_ordinary(text[r.doc_id])
            assert r.ids == ids and r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_bpe_edges(monkeypatch):
    import tiktoken

    tokens = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    codec, rng = bpe.Codec(tokens, P.PATTERN), np.random.default_rng(9)
    bits = ["a", "é", " ", "  ", "\n", "日", "1", "!", "\u0085", "😀", "the", "'s", "\t", " ", "٣", "ẞ", "_"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 80))) for _ in range(400)]
    monkeypatch.setattr(bpe, "SLICE", 40)
    for text, packed in zip(texts, codec.encode(texts)):
        assert np.frombuffer(packed, dtype="<u4").tolist() == own.encode_ordinary(text) and codec.decode(packed) == text.encode()


def test_chat_edges(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "bye"), (3, 0, "user", "hi"),
        (4, 0, "user", "other"), (5, 0, "user", "other"), (6, 0, None, None), (None, None, "user", "lost"), (7, 5, "user", "hi"), (7, 5, "user", "hi"), (7, 9, "user", "gap"),
    ]
    t = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, pos int")
    got = {r.conv_id: r for r in chat.format_conversations(t).collect()}
    assert set(got) == {2, 4, 6, 7, None}
    assert got[4].copies == 2 and got[7].n_turns == 2
    assert got[6].rendered == "<|im_start|>unknown\n<|im_end|>\n"
    long = spark.range(3000).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    short = long.filter("turn < 1500").withColumn("conv_id", F.lit(2).cast("bigint"))
    parts = chat.format_conversations(long.unionByName(short)).orderBy("part").collect()
    assert [(r.conv_id, r.part) for r in parts] == [(1, 0), (1, 1), (1, 2)] and parts[2].rendered.endswith("\n2999<|im_end|>\n")


@pytest.mark.parametrize("run", [256, 2])
def test_chat_against_sql_on_ties_and_gaps(spark, monkeypatch, run):
    monkeypatch.setattr(chat, "RUN", run)
    rng = np.random.default_rng(21)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    rows = [(pick([None, *range(25)]), pick([None, 0, 1, 2, 3, 900]), pick([None, "user", "assistant"]), pick([None, "", "a", "ab", "b" * 300, "ä"])) for _ in range(400)]
    for c in range(30, 45):  # snapshots of one conversation, with turn numbers that start elsewhere
        rows += [(c, t + c % 2, "user", f"t{t}") for t in range(c - 28)]
    got = chat.format_conversations(spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, cid string")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.sql(f"SELECT conv_id, n_turns, copies, part, rendered FROM ({chat.ORACLE})").fetchall()
    assert Counter(map(tuple, got)) == Counter(want) and len(want) > 20


def test_rows_are_dropped_by_id_and_text(spark):
    rows = [(1, "a b"), (2, "ab"), (2, "only here"), (None, "a b"), (None, "alone"), (None, "alone"), (3, None), (4, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, text_sha256 string")
    got = Counter((r.doc_id, r.text) for r in exact_dedup.drop_copies(docs).collect())
    assert got == Counter([(1, "a b"), (2, "only here"), (None, "alone"), (3, None)])


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, odd.limit(0), FOLDER)
        some = stage(spark, odd, FOLDER)
        assert none.count() == 0, name
        if name != "encode":
            assert some.columns == odd.columns, name
        ids = Counter(r.doc_id for r in some.collect())
        if name == "language_id":  # only those without a letter go
            assert ids == Counter([1, 2, 6, 7, 9, 9, None, 10, 11])
        elif name == "exact_duplicates":  # case matters, so 1 and 2 differ; 3, 4 and 5 are all empty, 5 is the longest
            assert ids == Counter([1, 2, 5, 6, 7, 8, 10, 11])
        elif name == "near_duplicates":  # 2, both rows of 9 and that without id have the words of 1, 4 and 5 have none like 3
            assert ids == Counter([1, 3, 6, 7, 8, 10, 11])
        elif name == "mix_sources":
            assert set(ids) == {i for i, *_ in ROWS}
        else:
            assert ids == Counter(i for i, *_ in ROWS)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, FOLDER)
        assert at.columns == docs.columns, name
    out = corpus_pipeline.run(spark, FOLDER).collect()
    texts = [r.text for r in docs.filter(F.col("doc_id").isin([r.doc_id for r in out])).collect()]
    assert len(set(texts)) == len(texts) and len(out) > 100
    assert connect(FOLDER).sql("SELECT count(*) FROM documents").fetchall()[0][0] == 200
