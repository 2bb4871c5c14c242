import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotloom.llm import exact_dedup, line_dedup, mixing, near_dedup, packing, pii, quality, sharding, topk_search, warc
from lotloom.llm.feistel import Permutation

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, _extra int"
ROWS = [
    (1, "a b c d e f g h", None, "s1", None, "x", None),
    (2, None, "en", None, 0, "x", 1),
    (2, None, "en", None, 0, "x", 1),
    (3, "", "en", "s1", 0, None, 1),
    (None, "a b\tc d e f g h ", "en", "s2", 0, None, 1),
    (4, "word " * 5000, "en", "s2", 0, None, 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    p = Permutation(n, 5)
    y = p.forward(np.arange(n))
    assert sorted(y) == list(range(n)) and (p.inverse(y) == np.arange(n)).all()


def test_sharding(spark, docs):
    rows = sharding.shard_rows(docs, ["doc_id", "text"], 4, 1).collect()
    by = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(4)}
    assert all(v == list(range(len(v))) for v in by.values()) and sorted(map(len, by.values())) == [1, 1, 2, 2]
    r = rows[0]
    assert sharding.place(r.row_number, 6, 4, 1) == (r.shard, r.slot) and sharding.row_at(r.shard, r.slot, 6, 4, 1) == r.row_number
    assert sharding.shard_rows(docs.limit(0), ["doc_id"], 4).count() == 0


def test_line_dedup(spark, docs):
    shared = "This line is in many documents."
    df = spark.createDataFrame([(i, f"own {i}\n {shared.upper() if i == 2 else shared}\t\n") for i in range(4)] + [(9, None), (None, shared)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_shared_lines(df).collect()}
    assert got[0] == ("own 0\n", 3, 1) and got[3][2] == 0 and got[9] == ("", 1, 0) and got[None] == ("", 1, 1)
    clash = line_dedup.drop_shared_lines(df.withColumns({"n_lines": F.lit("x"), "N_DROPPED": F.lit("y"), "_extra": F.lit(1)}))
    assert clash.columns == ["doc_id", "text", "_extra", "n_lines", "n_dropped"] and {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in clash.collect()} == got
    assert line_dedup.drop_shared_lines(docs).count() == 6 and line_dedup.drop_shared_lines(docs.limit(0)).count() == 0


def test_line_dedup_light_and_heavy_keys(spark, monkeypatch):
    """Keys that are broadcast and keys that are not drop the same lines."""
    rng = random.Random(4)
    pool = [f"a line that several documents may share, number {i}" for i in range(60)]
    texts = [[rng.choice(pool) if rng.random() < 0.5 else f"a line that only document {d} has, number {n}" for n in range(rng.randint(1, 12))] for d in range(80)]
    df = spark.createDataFrame([(d, "\n".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    holders = {}
    for d, t in enumerate(texts):
        for line in t:
            holders.setdefault(line, set()).add(d)
    want = {d: "\n".join(x for x in t if len(holders[x]) < 3 or max(holders[x]) == d) for d, t in enumerate(texts)}
    for heavy in (1, 40, 4096):
        monkeypatch.setattr(line_dedup, "HEAVY", heavy)
        assert {r.doc_id: r.text for r in line_dedup.drop_shared_lines(df).collect()} == want


def test_exact_dedup(spark, docs):
    got = exact_dedup.exact_groups(docs)
    assert got.where("kept").count() == 3 and {r.group_size for r in got.collect()} == {1, 2, 3}
    assert sorted(r.doc_id or 0 for r in exact_dedup.drop_exact_copies(docs).collect()) == [0, 2, 4]
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0
    clash = exact_dedup.drop_exact_copies(docs.withColumns({"kept": F.lit(1), "group_size": F.lit(2)}))
    assert clash.columns == [*docs.columns, "kept", "group_size"] and clash.count() == 3


def test_exact_dedup_of_other_than_frequent_digests(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HEAVY", 1)
    df = spark.createDataFrame([(i, f"t{i % 5}" + " " * (i % 7)) for i in range(100)], "doc_id long, text string")
    got = exact_dedup.exact_groups(df).collect()
    best = {g: min((-(len(f"t{g}") + i % 7), i) for i in range(100) if i % 5 == g)[1] for g in range(5)}
    assert all((r.keep_id, r.group_size, r.kept) == (best[r.doc_id % 5], 20, r.doc_id == best[r.doc_id % 5]) for r in got) and len(got) == 100
    assert {r.doc_id for r in exact_dedup.drop_exact_copies(df).collect()} == set(best.values())


def test_mixing(spark, docs):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, " ".join("w" * rng.randint(1, 60)), f"s{i % 5}") for i in range(400)], "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert abs(sum({r.source_size: r.target for r in rows}.values()) - 1.5 * sum(r.size for r in rows)) < 1
    assert abs(sum(r.taken for r in rows) - 1.5 * sum(r.size for r in rows)) < 0.02 * sum(r.size for r in rows)
    assert {tuple(r) for r in rows} == {tuple(r) for r in mixing.mix(df.repartition(3)).collect()}
    assert mixing.mix(docs).count() == 6 and mixing.mix(docs.limit(0)).count() == 0
    assert mixing.repeat_by_mix(docs).columns == docs.columns and mixing.repeat_by_mix(docs.limit(0)).count() == 0


def test_mixing_repeats_rows_as_taken(spark):
    """Rows alike in id, source and text share their times; the others have their own."""
    rng = random.Random(6)
    rows = [(i if i % 10 else None, " ".join("w" * rng.randint(1, 30)), f"s{i % 3}") for i in range(200)]
    df = spark.createDataFrame(rows + rows[:40], "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    taken = {}
    for r in mixing.mix(df).collect():
        taken.setdefault((r.doc_id, r.size), []).append((2 * r.taken + r.size) // (2 * r.size))
    got = {}
    for r in mixing.repeat_by_mix(df).collect():
        key = (r.doc_id, len(r.text.split()))
        got[key] = got.get(key, 0) + 1
    assert got == {k: sum(v) for k, v in taken.items() if sum(v)}


def test_first_fit_decreasing():
    rng = random.Random(1)
    lengths = [rng.randint(1, 100) for _ in range(300)]
    want, free = {}, []
    for i in sorted(range(300), key=lambda i: -lengths[i]):
        b = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
        if b == len(free):
            free.append(100)
        want[i] = (b, 100 - free[b])
        free[b] -= lengths[i]
    assert packing.first_fit_decreasing(lengths, 100) == [want[i] for i in range(300)]


def test_packing(spark, docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = str(P.path("word_bpe_49k.json"))
    tk, own = Tokenizer.from_file(path), packing.encoder(path)
    for w in [*tk.get_vocab()][::7]:  # every token's own merges lead to it in both
        t = w.removesuffix("</w>")
        assert own.encode(t.encode()) == np.array(tk.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    odd = ["J\u030c H\u0331 T\u0308 W\u030a", "\u0130stanbul STRASSE \u00c9cole e\u0301cole E\u0301COLE \u03a3\u0399\u03a3", "a\u00a0b\u2003c\u0085d", "x\x1cy <|endoftext|> don't DON'T 3.14 \u0663\u0664 \ufb01n", "\u1e9e\u0345 \u01c5 \u212b"]
    sample = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for t in odd + sample:
        assert own.encode(t.encode()) == np.array(tk.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t[:80]
    rows = packing.pack(docs, path, 1, 2048, with_ids=True).collect()
    by = {}
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 2048
    ids = sum((r.ids for r in sorted((r for r in rows if r.doc_id == 4), key=lambda r: r.start)), [])
    assert ids == [*tk.encode(ROWS[5][1], add_special_tokens=False).ids, 1]
    assert packing.pack(docs.limit(0), path, 1).count() == 0


PAGES = [(1, "http://A.org/x", "p\r\n\r\nq"), (2, None, "p\r\n\r\nq"), (3, "a\r\nb", None), (4, "http://a.org/x", "z" * 70000), (None, "http://b.org", "q"), (5, "http://b.org", "q"), (5, "http://b.org", "q")]


def test_warc(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/w")
    read = warc.read_archives(spark, f"file://{tmp_path}/w", True)
    got = {r.page_id: r for r in read.collect()}
    assert got[1].refers_to == 2 and got[1].payload_bytes == 6 and got[2].record_type == "response" and got[3].payload_bytes == 0
    assert got[None].refers_to == 5 and got[5].record_type == "response"
    warc.write_index(read, f"file://{tmp_path}/i")
    index = warc.CaptureIndex(spark, f"file://{tmp_path}/i")
    found = list(index.captures("https://www.a.org/x"))
    assert {c["page_id"] for c in found} == {1, 4} and index.payload(next(c for c in found if c["page_id"] == 4)) == b"z" * 70000
    assert not list(index.captures("http://nowhere.org"))
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_warc_look_up_equals_scan(spark, tmp_path, monkeypatch):
    """All URLs through the index, with small blocks and few directory entries at a time, give what a scan gives."""
    monkeypatch.setattr(warc, "BLOCKS_AT_ONCE", 3)
    pages = PAGES + [(100 + i, f"http://h{i % 7}.org/{i % 50}", f"page {i % 90}") for i in range(2500)] + [(5000 + i, "http://hot.org/", f"hot {i}") for i in range(2500)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/w")
    scan = warc.read_archives(spark, f"file://{tmp_path}/w")
    warc.write_index(scan, f"file://{tmp_path}/i")
    index = warc.CaptureIndex(spark, f"file://{tmp_path}/i")
    assert index.directory.count() > 4
    assert sorted(map(str, index.look_up(df).collect())) == sorted(map(str, scan.collect()))
    hot = spark.createDataFrame([("https://www.hot.org/",), (None,)], "url string")
    assert sorted(r.page_id for r in index.look_up(hot).collect()) == [2, *range(5000, 7500)]


def test_gzip_members_of_any_size():
    rng = random.Random(1)
    records = [b"", b"x", rng.randbytes(100), b"a" * (17 << 20), rng.randbytes(17 << 20)]
    packed = [warc.member(r) for r in records]
    assert all(p[-1] == 0 for p in packed) and [m[2] for m in warc.members(b"".join(packed))] == records


def _best(q, i, k):
    """(-score, position) of the k best rows for row i of the whole-number vectors q."""
    s = q @ q[i]
    return sorted((-int(s[j]), j) for j in range(len(q)) if j != i)[:k]


def test_top_k(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[5] = v[6]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [float("nan")] * 8), (902, [None] * 8), (903, [1.0] * 3)], "vec_id long, embedding array<float>")
    q = np.floor(64 * v.astype(float)).astype(int)
    got = topk_search.top_k(df, F.col("vec_id").isin(0, 20, 903), 5).orderBy("query_id", "rank").collect()
    for i in (0, 20):
        assert [(-r.score, r.vec_id) for r in got if r.query_id == i] == _best(q, i, 5)
    assert {r.query_id for r in got} == {0, 20}
    assert topk_search.top_k(df.limit(0), F.lit(True), 5).count() == 0
    twice = spark.createDataFrame([(1, [1.0]), (1, [1.0]), (2, [-1.0])], "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in topk_search.top_k(twice, F.col("vec_id") == 1, 5).collect()] == [(1, 1, 1, 4096), (1, 2, 2, -4096)] * 2


@pytest.mark.parametrize("clusters", [30, 0])
def test_top_k_over_many_blocks(spark, monkeypatch, clusters):
    """Small blocks, so that all passes run: clustered vectors, whose block pairs are pruned, and uniform ones."""
    monkeypatch.setattr(topk_search, "DATA_BLOCK", 64)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3000, 16))
    if clusters:
        v = 4 * rng.normal(size=(clusters, 16))[rng.integers(0, clusters, 3000)] + 0.05 * v
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    q = np.floor(64 * v).astype(int)
    got = {}
    for r in topk_search.top_k(df, F.col("vec_id") % 20 == 0, 7).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert got == {i: _best(q, i, 7) for i in range(0, 3000, 20)}


def test_cover_trees_prune():
    rng = np.random.default_rng(2)
    v = np.floor(64 * (4 * rng.normal(size=(30, 16))[rng.integers(0, 30, 2000)] + 0.05 * rng.normal(size=(2000, 16)))).astype(np.int64)
    data, queries = topk_search.CoverTree(v), topk_search.CoverTree(v[::20])
    assert len(data.centre) > 30 and any(data.children)
    for node, below in enumerate(data.children):  # every row lies within its node's radius, and in one child
        away = np.sqrt(((v[data.rows[node]] - v[data.centre[node]]) ** 2).sum(1))
        assert (away <= data.radius[node]).all() and (not below or sorted(np.concatenate([data.rows[c] for c in below])) == sorted(data.rows[node]))
    score, place, computed = topk_search.dual_tree_top_k(queries, np.arange(0, 2000, 20), data, np.arange(2000), np.arange(2000), 5)
    assert computed < 0.5 * len(v) * len(v[::20])
    assert all([(-int(s), int(p)) for s, p in zip(score[i], place[i])] == _best(v, 20 * i, 5) for i in range(100))


def _classes_by_brute_force(texts):
    """The least index in each text's class, over all pairs."""
    sets = near_dedup.shingle_counts([(t or "").encode() for t in texts])
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if root[i] != root[j] and near_dedup.prob_jaccard(sets[i], sets[j]) >= 0.8 - 1e-9:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return dict(enumerate(root))


def test_near_dedup(spark, docs):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 999)}" for _ in range(200)]
    texts = [" ".join(base)] + [" ".join(base[:i] + ["new"] + base[i + 1 :]) for i in range(3, 190, 9)] + [" ".join(f"v{rng.randint(0, 999)}" for _ in range(200)) for _ in range(10)]
    texts += ["", None, " one  two ", "ONE two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = _classes_by_brute_force(texts)
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(df).collect()} == want
    kept = near_dedup.drop_near_copies(df.withColumn("_ll_row", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "_ll_row"] and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert near_dedup.near_classes(docs).count() == 6 and near_dedup.near_classes(docs.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in near_dedup.drop_near_copies(docs).collect()) == [1, 2, 4] and near_dedup.drop_near_copies(docs.limit(0)).count() == 0


def _chained():
    """Two groups of variants that only texts between them join, and one of weighted shingles."""
    a, b = [f"a{i}" for i in range(200)], [f"b{i}" for i in range(200)]
    mixed = lambda k: a[: 200 - k] + b[200 - k :]
    variants = lambda words, n: [words[:i] + [f"v{i}"] + words[i + 1 :] for i in range(n)]
    groups = [mixed(0), *variants(mixed(0), 150), mixed(14), mixed(41), *variants(mixed(41), 150), mixed(27)]
    repeats = [["x", "y", "z", "u", "v"] * 30 + [f"r{i}", f"r{i + 1}"] for i in range(20)]
    return [" ".join(w) for w in groups + repeats]


@pytest.mark.parametrize(("rows", "size"), [(4096, 1 << 24), (16, 1 << 24), (4096, 20000)])
def test_near_dedup_blocks(spark, rows, size):
    """Groups of over 300 near copies: whether they fit a block or not, classes are those of all pairs."""
    texts = _chained()
    want = _classes_by_brute_force(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_dedup.near_classes(df, block_rows=rows, block_bytes=size).collect()
    assert {r.doc_id: r.class_id for r in got} == want and max(r.class_size for r in got) > 300


def test_near_dedup_pairs_of_different_blocks(spark):
    """Members of one bucket in blocks of one text each are still compared pair by pair."""
    texts = _chained()[::9]
    want = _classes_by_brute_force(texts)
    rows = [(i, i, i, i, len(t), [1], t) for i, t in enumerate(texts)]
    names = f"{near_dedup.ROW} long, {near_dedup.ID} long, {near_dedup.K1} long, {near_dedup.K2} long, bytes long, bands array<long>, {near_dedup.TEXT} string"
    df = spark.createDataFrame(rows, names)
    got = near_dedup._links(df.drop(near_dedup.TEXT), df.select(near_dedup.ID, near_dedup.TEXT, near_dedup.K1, near_dedup.K2), 0.8, 1, 1)
    roots = {r.node: r.root for r in got.collect()}
    assert {i: roots.get(i, i) for i in range(len(texts))} == want


def test_prob_min_hash_estimates_similarity():
    a = (np.arange(1, 60, dtype=np.uint64), np.arange(1, 60) % 5 + 1.0)
    b = (np.arange(10, 75, dtype=np.uint64), np.arange(10, 75) % 4 + 1.0)
    n = 3000
    same = (near_dedup.prob_min_hash(*a, n) == near_dedup.prob_min_hash(*b, n)).mean()
    exact = sum(1 / sum(max(dict(zip(*a)).get(e, 0) / wa, dict(zip(*b)).get(e, 0) / dict(zip(*b))[d]) for e in {*a[0], *b[0]}) for d, wa in zip(*a) if d in b[0])
    assert abs(near_dedup.prob_jaccard(a, b) - exact) < 1e-9 and abs(same - exact) < 0.04


def test_pii(spark, docs):
    text = "card 4207051279108084, 4207-0512-7910-8084 ip 28.125.121.88! call +1 (375) 555-4393 mail fakol.33@mail7.example.com born 1984-02-29, no date 2023-02-30, not 4207051279108085"
    df = spark.createDataFrame([(1, text), (2, "same card: 4207 0512 7910 8084."), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    r = got[1]
    assert (r.n_card, r.n_ip, r.n_phone, r.n_email, r.n_date) == (2, 1, 1, 1, 1) and len(r.text) == len(text) - len("28.125.121.88") + len(r.text.split("ip ")[1].split("!")[0])
    for gone in ("4207051279108084", "28.125.121.88", "555-4393", "fakol", "1984-02-29"):
        assert gone not in r.text
    assert "2023-02-30" in r.text and "4207051279108085" in r.text and got[3].text == ""
    number = r.text.split()[1].strip(",")
    assert got[2].text.removeprefix("same card: ").rstrip(".").replace(" ", "") == number
    assert pii.pseudonymise(docs, "k").count() == 6


def _pseudonyms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect()]


def test_pii_long_mail_names(spark):
    names = ["abcdefghijklmnopqrstuvwxyz" + x for x in ("", "a", "b", "firstmiddlelastdepartment", "x" * 38)] + ["1" * 26 + "2" * 30, "b" + "a" * 25 + "firstmiddlelastdepartment"]
    got = [r.text.split("@")[0] for r in _pseudonyms(spark, [f"{n}@mail.example.com" for n in names])]
    assert [len(g) for g in got] == [len(n) for n in names] and len(set(got)) == len(names) and got[1][:26] == got[0]
    assert all(g[26:] != n[26:] for g, n in zip(got[3:], names[3:], strict=True)) and got[3][26:] != got[6][26:]


def test_pii_beside_letters_and_words(spark):
    joined = ["2024-01-15T10:00:00Z", "10.0.0.1-10.0.0.9", "on2024-01-15.Then", "ip:10.0.0.1.example", "ssn123-45-6789x", "550e8400-e29b-41d4-a716-446655440000", "0.4111111111111111", "1.2.3.4.5", "No4111111111111111USD"]
    day, first, last, *got = _pseudonyms(spark, ["2024-01-15", "10.0.0.1", "10.0.0.9", *joined])
    assert [r.text for r in got[:4]] == [f"{day.text}T10:00:00Z", f"{first.text}-{last.text}", f"on{day.text}.Then", f"ip:{first.text}.example"]
    assert (got[1].n_ip, got[0].n_date, got[4].n_ssn, got[8].n_card) == (2, 1, 1, 1) and [r.text for r in got[5:8]] == joined[5:8]


def test_pii_card_beside_other_numbers(spark):
    card, spaced = "4111111111111111", "4111 1111 1111 1111"
    parts = [f"{spaced} 12/25", f"{card} 123", f"12 {card}", f"12345 {spaced} 678 9", f"{card} 2024-01-15", f"{spaced} {card}", f"{card} 12-a@mail.example.com"]
    new, *got = _pseudonyms(spark, [card, *parts])
    new = new.text
    plain = [r.text.replace(" ", "") for r in got]
    assert new != card and plain[:4] == [f"{new}12/25", f"{new}123", f"12{new}", f"12345{new}6789"] and plain[4][:16] == plain[6][:16] == new
    assert [r.n_card for r in got[:6]] == [1, 1, 1, 1, 1, 2] and got[4].n_date == got[6].n_email == 1 and plain[5] == new * 2


def test_quality(spark, docs):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["the", "of", "house", "tree", "and", "river"]) for _ in range(60)) + "."
    bad = lambda: " ".join([rng.choice(["spam", "BUY!!", "click"])] * 60)
    rows = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(240)]
    df = spark.createDataFrame([r[:2] for r in rows] + [(999, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (7, None)], "doc_id long, quality int")
    scored = {r.doc_id: r.score for r in quality.with_score(df, quality.train(df, labels)).collect()}
    out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum((scored[r[0]] >= 0.5) == r[2] for r in out) >= 0.95 * len(out) and 0 <= scored[999] <= 1
    assert quality.with_score(docs, quality.train(docs, labels.limit(0))).count() == 6


def test_quality_against_plain_nb_svm():
    """Weights and bias of the fit are those of naive Bayes ratios and dual coordinate descent in plain Python."""
    rng = np.random.default_rng(8)
    labels = (np.arange(80) % 2).astype(np.int64)
    rows = [np.unique(np.concatenate((rng.integers(0, 40, 6), rng.integers(40 * y + 100, 40 * y + 140, 5)))) for y in labels]
    model = quality.fit_rows(rows, labels, seed=3)
    draw = np.random.default_rng(3)
    kept = draw.random(80) < 0.2
    fit = [i for i in range(80) if not kept[i]]
    count = [{}, {}]
    for i in fit:
        for f in rows[i].tolist():
            count[labels[i]][f] = count[labels[i]].get(f, 0) + 1
    whole = [quality.FEATURES + sum(c.values()) for c in count]
    ratio = {f: np.log((count[1].get(f, 0) + 1) / whole[1]) - np.log((count[0].get(f, 0) + 1) / whole[0]) for f in {*count[0], *count[1]}}
    x = [{f: ratio[f] for f in r.tolist() if f in ratio} for r in rows]
    x = [{f: v / max(1e-12, sum(u * u for u in r.values()) ** 0.5) for f, v in r.items()} for r in x]
    w, bias, alpha = dict.fromkeys(ratio, 0.0), 0.0, dict.fromkeys(fit, 0.0)
    for _ in range(quality.EPOCHS):
        moved = 0.0
        for at in draw.permutation(len(fit)):
            i = fit[at]
            y = 2 * labels[i] - 1
            gradient = y * (sum(w[f] * v for f, v in x[i].items()) + bias) - 1
            new = min(max(alpha[i] - gradient / (sum(v * v for v in x[i].values()) + 1), 0), quality.COST)
            step, alpha[i] = (new - alpha[i]) * y, new
            bias += step
            for f, v in x[i].items():
                w[f] += step * v
            moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    mean = sum(map(abs, w.values())) / len(w)
    want = {f: ((1 - quality.BETA) * mean + quality.BETA * v) * ratio[f] for f, v in w.items()}
    assert abs(model.bias - bias) < 1e-6 and all(abs(float(model.weights[f]) - v) < 1e-4 for f, v in want.items())


def test_quality_bounds(spark):
    """The bounds on rows and numbers hold, repeated documents included, and reruns agree."""
    df = spark.createDataFrame([(i % 30, f"w{i % 7} v{i % 3} x{i}") for i in range(90)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    for bounds in ({"max_rows": 12}, {"max_numbers": 200}, {}):
        a, b = quality.train(df, labels, **bounds), quality.train(df.repartition(5), labels, **bounds)
        assert (a.weights == b.weights).all() and a.bias == b.bias
    out = quality.with_score(df, a)
    assert out.columns == ["doc_id", "text", "score"] and out.schema["score"].dataType.simpleString() == "double" and quality.with_score(df.limit(0), a).count() == 0
    assert quality.train(df.limit(0), labels).weights.any() == False  # noqa: E712


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii_pseudonyms_are_valid_and_one_to_one(spark):
    import datetime

    days = [(datetime.date(1900, 1, 1) + datetime.timedelta(days=37 * i)).isoformat() for i in range(1900)]
    cards = []
    for i in range(1500):
        body = f"4{i:014d}"
        cards.append(next(body + c for c in "0123456789" if _luhn(body + c)))
    ips = [f"{i % 256}.{i // 256}.7.9" for i in range(1500)]
    ssns = [f"{i % 665 + 1:03d}-{i % 99 + 1:02d}-{i + 1:04d}" for i in range(1500)]
    phones = [f"+1 ({200 + i % 700}) {200 + i // 2}-{i:04d}" for i in range(1500)]
    for kind, values in (("date", days), ("card", cards), ("ip", ips), ("ssn", ssns), ("phone", phones)):
        got = [r.text for r in _pseudonyms(spark, values)]
        assert len(set(got)) == len(values) and [r for r, v in zip(got, values, strict=True) if r == v] == [r for r, v in zip(got, values, strict=True) if r == v][:3]
        if kind == "date":
            assert all("1900-01-01" <= datetime.date.fromisoformat(g).isoformat() <= "2099-12-31" for g in got)
        if kind == "card":
            assert all(len(g) == 16 and _luhn(g) for g in got)
        if kind == "ip":
            assert all(len(g.split(".")) == 4 and all(0 <= int(x) <= 255 for x in g.split(".")) for g in got)
        if kind == "ssn":
            assert all(g[3] == g[6] == "-" and 1 <= int(g[:3]) <= 899 and g[:3] != "666" and int(g[4:6]) and int(g[7:]) for g in got)
        if kind == "phone":
            assert all(len(g) == len(v) and g.startswith("+1 (") and g[4] in "23456789" for g, v in zip(got, values, strict=True))


def test_pii_of_nothing_and_with_clashing_columns(spark, docs):
    assert pii.pseudonymise(docs.limit(0), "k").count() == 0
    df = spark.createDataFrame([(1, "born 1984-02-29", "x"), (2, "", "y"), (3, "word " * 20000 + "1984-02-29", "z")], "doc_id long, text string, n_date string")
    out = pii.pseudonymise(df.withColumn("N_CARD", F.lit(1)), "k")
    assert out.columns[:2] == ["doc_id", "text"] and sorted(out.columns[2:]) == sorted(f"n_{k}" for k in pii.KINDS)
    assert {r.doc_id: r.n_date for r in out.collect()} == {1: 1, 2: 0, 3: 1}


SF = "/root/testdata/sf0.001"


def test_near_dedup_recall_over_all_pairs(spark):
    """All documents of the table against all: no pair at the threshold is in two classes, and no class is wider."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    # all pairs that could reach the threshold, by the largest similarity that common shingles allow
    sets = dict(zip(ids, near_dedup.shingle_counts([(texts[i] or "").encode() for i in ids]), strict=True))
    holders = {}
    for i in ids:
        for v in sets[i][0].tolist():
            holders.setdefault(v, []).append(i)
    common = {}
    for held in holders.values():
        for n, j in enumerate(held):
            for i in held[:n]:
                common[i, j] = common.get((i, j), 0) + 1
    links = [(i, j) for (i, j), n in common.items() if n >= 0.5 * min(len(sets[i][0]), len(sets[j][0])) and near_dedup.prob_jaccard(sets[i], sets[j]) >= 0.8 - 1e-9]
    empty = [i for i in ids if not len(sets[i][0])]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links + [(empty[0], j) for j in empty[1:]]:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    found = sum(got[i] == got[j] for i, j in links)
    print(f"near-dedup recall: {found} of {len(links)} links")
    assert len(links) > 50 and found == len(links) and got == {i: find(i) for i in ids}


def test_pipeline_against_plain_python(spark):
    """run() stage by stage in plain Python: scores of the fitted model, equal texts, all pairs, quotas, ids."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    scores = model.score([r.text for r in rows])
    good = [r for r, s in zip(rows, scores, strict=True) if s >= 0.3]
    assert 0 < len(good) < len(rows)
    best = {}
    for r in good:
        t = r.text or ""
        key = t.translate(dict.fromkeys(map(ord, " \t\n\x0b\x0c\r")))
        best[key] = min(best.get(key, (1, 0, None)), (-len(t), r.doc_id, r), key=lambda x: x[:2])
    single = sorted((b[2] for b in best.values()), key=lambda r: r.doc_id)
    assert len(single) < len(good)
    classes = _classes_by_brute_force([r.text for r in single])
    apart = [r for i, r in enumerate(single) if classes[i] == i]
    assert len(apart) < len(single)
    docs_ = docs
    want = [good, single, apart]
    for (name, stage), kept in zip(corpus_pipeline.STAGES, want, strict=False):
        docs_ = stage(spark, docs_, SF)
        assert sorted(map(tuple, docs_.collect())) == sorted(map(tuple, kept)), name
    times = {}
    for r in mixing.mix(spark.createDataFrame(apart, docs.schema)).collect():
        n = (2 * r.taken + r.size) // (2 * r.size) if r.size else 0
        if n:
            times[r.doc_id] = n
    by_source = {}
    for r in apart:
        by_source.setdefault(r.source, [0, 0])
        size = len((r.text or "").split())
        by_source[r.source][0] += size
        by_source[r.source][1] += size * times.get(r.doc_id, 0)
    out = corpus_pipeline.run(spark, SF).collect()
    tk = Tokenizer.from_file(str(P.path("word_bpe_49k.json")))
    pieces, sequences = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(times)
    text = {r.doc_id: r.text for r in apart}
    for doc, got in pieces.items():
        ids = [*tk.encode(text[doc] or "", add_special_tokens=False).ids, 1]
        cut = [(s, min(2048, len(ids) - s), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(cut * times[doc])
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:])) and parts[-1][0] + parts[-1][1] <= 2048


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.select("doc_id").distinct().count() <= docs.count()
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0 and (name == "packing" or empty.columns == docs.columns)
