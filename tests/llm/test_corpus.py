"""The corpus operators on small fixtures, against brute force or exact round trips."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from quarrylake.llm import embeddings, fingerprint, langid, linededup, minhash, packing, pieces, queries, substring, tokenshards, urlfilter
from quarrylake.llm.wordmemo import token_batches, vocabulary_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, v int, rep int"


def _docs(spark, texts):
    """Null id, repeated row, null, empty and long texts, columns that clash with inner names."""
    rows = [(k, t, "en", "s", len(t or ""), "x", 1, 2) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "alone here", None, None, None, None, None, None), rows[0]], DOCS)


TEXTS = [
    "a b c d e f g", None, "", " \n\t ", "A B c d e f g", "x " * 3000, "one", "l1\nl2\nl3\nl4\nl5\nl6\nl7", "l1\nl2\nl3\nl4\nl5\nl6\nl7",
    " ".join(f"w{i}" for i in range(60)), "q " + " ".join(f"w{i}" for i in range(60)), "日本 😀 don't",
]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(name, spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    cols = sorted(c[0] for c in want.description)
    want = [tuple(r[k] for k in sorted(range(len(cols)), key=lambda k: want.description[k][0])) for r in want.fetchall()]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == cols
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, want))


CLASH = "id row v text2 k h chunk lines hashes ends chunks gone gid gv __id __v __text __starts __counts __rid __rv __kept t c0 host fit code word bin part slot runs short"


def _clashing(spark, texts):
    """Columns with the names that operators use inside, all kept as they are."""
    rows = [(k, t, "en", len(t or ""), *([f"x{k}"] * len(CLASH.split()))) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH.split()))


def test_edges_of_every_operator(spark):
    docs = _docs(spark, TEXTS)
    n, none = docs.count(), docs.limit(0)
    model = langid.fit(docs, steps=2)
    for run in (minhash.near_duplicates, linededup.dedup_lines, substring.dedup_substrings, fingerprint.fingerprints, pieces.encode_documents, lambda d: langid.predict(d, model)):
        assert run(docs).count() == n, run
        assert run(none).count() == 0, run
    assert packing.pack(docs).select("doc_id").distinct().count() == len(TEXTS) + 1 and packing.pack(none).count() == 0
    assert langid.predict(none, langid.fit(none)).count() == 0 and langid.stage(spark, none, SF).count() == 0
    assert urlfilter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_names_that_clash(spark):
    docs = _clashing(spark, TEXTS)
    names = [c for c in docs.columns if c != "text"]
    model = langid.fit(docs, steps=2)
    for run in (linededup.dedup_lines, substring.dedup_substrings, lambda d: langid.predict(d, model), lambda d: urlfilter.filter_urls(d.withColumnRenamed("text", "url"))):
        got = run(docs)
        own = [c for c in names if c not in ("host",)] if "verdict" in got.columns else names
        assert sorted(map(tuple, got.select(own).collect()), key=repr) == sorted(map(tuple, docs.select(own).collect()), key=repr), run
    names.remove("n_chars")  # follows the text
    want = sorted(map(tuple, docs.select(names).collect()), key=repr)
    for stage in (langid.stage, linededup.stage, minhash.stage, substring.stage):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and set(map(tuple, out.select(names).collect())) <= set(want), stage
    assert minhash.near_duplicates(docs).count() == fingerprint.fingerprints(docs).count() == pieces.encode_documents(docs).count() == len(TEXTS)


def test_edge_values(spark):
    docs = _docs(spark, TEXTS)
    near = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (0, 3, 0, True), (4, 3, 0, False), (5, 1, 5, True), (8, 3, 7, False), (None, 1, None, True)} <= near
    cut = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.dedup_substrings(docs).collect()}
    assert {(1, 0, 0, None), (2, 0, 0, ""), (3, 0, 0, ""), (5, 3000, 3000, ""), (9, 60, 60, ""), (10, 61, 60, "q"), (None, 2, 0, "alone here")} <= cut
    enc = {r["doc_id"]: r for r in pieces.encode_documents(docs).collect()}
    assert enc[1]["nbest_ids"] is None and enc[2]["nbest_ids"] == [[]] and enc[2]["nbest_scores"] == [0.0] and enc[11]["decoded"] == TEXTS[11]
    prints = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    assert prints[1]["fingerprint"] == prints[2]["fingerprint"] and prints[1]["n_chars"] == 0 and prints[None]["near_next"] == 0.0
    assert prints[7]["fingerprint"] == prints[8]["fingerprint"] and prints[7]["near_next"] < 1 == prints[8]["near_next"]
    packed = {(r["doc_id"], r["start"], r["length"], r["doc_tokens"]) for r in packing.pack(docs).collect()}
    assert {(1, 0, 1, 1), (2, 0, 1, 1), (3, 0, 1, 1), (5, 0, 2048, 3001), (5, 2048, 953, 3001)} <= packed


def test_packing(spark):
    docs = _docs(spark, TEXTS)
    got = packing.pack(docs).toPandas().sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= packing.WINDOW
    ids = np.append(next(iter(token_batches([TEXTS[5]]))), 1).astype("<u4")
    own = got[got.doc_id == 5].sort_values("start")
    assert own["length"].sum() == len(ids) == own.doc_tokens.iloc[0]
    assert all(zlib.crc32(ids[a : a + m].tobytes()) == c for a, m, c in zip(own.start, own.length, own.ids_crc32))


@pytest.mark.parametrize("window", [2, 7, 100, 300, 1000, 2047, 2049])
def test_packing_for_any_window(spark, window):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    got = packing.pack(docs, window).toPandas().sort_values(["sequence_id", "offset"])
    sums = got.groupby("sequence_id")["length"]
    assert sums.sum().max() <= window and (sums.cumsum() - got["length"] == got["offset"]).all()
    own = got.sort_values(["doc_id", "start"]).groupby("doc_id")
    assert (own["length"].sum() == own["doc_tokens"].first()).all() and (own["length"].cumsum() - got["length"] == got["start"]).all()
    if window >= 1000:
        assert got["length"].sum() / (sums.ngroups * window) > 0.9


def test_tokens_are_the_library_s(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path(None, "word_bpe_49k.json"))
    odd = [
        "", None, "ΑΣ ΟΔΟΣ x", "don't I'll WE'VE", "<|endoftext|> Hi <|EndOf", "été café", "日本語 テスト 😀😀 x😀y", "\x00 \x1f z\x85q", "123abc4.5,6",
        "____--!!a!b", "İstanbul ǅ ﬁ ß", "x" * 3000 + "!" + "9" * 2000, "\u0301a", "مرحبا بالعالم", "a\u200bb\u200d", "क्षि हिन्दी", "tab\tnl\nrr\r\x0b\x0cend", "ᾼ ῼ", "Ⅷ ⅷ ① ²", "'s 's a's \"q\"",
    ]
    texts = odd + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for t, ids in zip(texts, token_batches(texts)):
        assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def test_nnls_and_plan():
    rng = np.random.default_rng(0)
    a, x = rng.random((20, 8)), np.maximum(rng.normal(size=8), 0)
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    counts = rng.integers(0, 500, 257)
    counts[0] = 0
    used = np.zeros(257, int)
    for mix, repeats in packing.plan(counts):
        assert sum(b * m for b, m in mix.items()) <= 256
        for b, m in mix.items():
            used[b] += m * repeats
    assert (used == counts).all()


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.9
    model = langid.fit(docs, steps=50)
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.predict(_docs(spark, TEXTS), model).collect()}
    assert odd[1] == odd[2] == odd[3] == "und" and odd[0] != "und"


def test_gru_gradient():
    gru = langid.GRU(np.random.default_rng(5), 3)
    gru.p = {k: v.astype(np.float64) for k, v in gru.p.items()}
    x = np.random.default_rng(6).integers(0, 256, (7, 4))
    states, cache = gru.forward(x, keep=True)
    got = gru.backward(x, cache, np.ones_like(states))
    for name, at in (("u", (0, 0)), ("u", (4, 1)), ("v", (1, 2)), ("w", (2, int(x[0, 0]))), ("w", (7, int(x[3, 1]))), ("b", (5, 0))):
        eps, sums = 1e-3, []
        for sign in (1, -1):
            gru.p[name][at] += sign * eps
            sums.append(gru.forward(x).sum(dtype=np.float64))
            gru.p[name][at] -= sign * eps
        assert abs(got[name][at] - (sums[0] - sums[1]) / (2 * eps)) < 2e-2 * max(1, abs(got[name][at])), name


def test_sketch():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = np.unique(base[:350]), np.unique(base[50:])
    same = (minhash.sketch(a) == minhash.sketch(b)).mean()
    assert abs(same - 300 / 400) < 0.06 and not (minhash.sketch(a[:1]) == np.uint64(2**64 - 1)).any()
    few = np.mean([(minhash.sketch(base[k : k + 3]) == minhash.sketch(base[k + 1 : k + 4])).mean() for k in range(0, 300, 4)])
    assert abs(few - 2 / 4) < 0.03  # few elements fill their coordinates in late rounds


def test_minhash_group(spark):
    words = [f"w{i}" for i in range(80)]
    near = [" ".join(words[:k] + ["z"] + words[k:]) for k in range(0, 80, 4)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(_docs(spark, near)).collect()}
    assert {got[k] for k in range(len(near))} == {0}


def test_fingerprint(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id", ascending=False).collect()]
    want = {}
    for k, (i, t) in enumerate(rows):
        m, after = len(t) // 3, rows[(k + 1) % len(rows)][1]
        want[i] = hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest()
    got = fingerprint.query(spark, SF).toPandas()
    assert dict(zip(got.doc_id, got.edited_sha256)) == want
    # with a third of a text replaced only small lexicons can agree; a next document shares hardly any
    assert (got.near_edited > got.near_next).mean() > 0.8 and got.near_edited.mean() > 10 * got.near_next.mean() and got.near_next.mean() < 0.02


def test_shards(spark, tmp_path):
    for n in (1, 2, 3, 100, 4097):
        assert sorted(tokenshards.permute(np.arange(n), n).tolist()) == list(range(n))
    docs, folder = _docs(spark, TEXTS), f"file://{tmp_path}/o"
    index = tokenshards.write_shards(docs, folder, length=16, shard=8).toPandas().set_index("slot").sort_index()
    data = tokenshards.read_shards(spark, folder).toPandas().set_index("slot").sort_index()
    assert sorted(index.index) == sorted(data.index) == list(range(len(index))) and (index.crc32 == data.crc32).all()
    # one group: all documents in the order of id, each with its end; every id stands once
    order = [None, 0, *range(len(TEXTS))]
    texts = ["alone here" if k is None else TEXTS[k] for k in order]
    stream = np.concatenate([np.append(ids, 1) for ids in token_batches(texts)])
    begins = np.cumsum([0] + [len(ids) + 1 for ids in token_batches(texts)])
    slots = tokenshards.permute(np.arange(len(index)), len(index))
    assert len(index) == -(-len(stream) // 16)
    for g, slot in enumerate(slots.tolist()):
        part = stream[16 * g : 16 * g + 16].tolist()
        assert tokenshards.unpack(data.data[slot]) == part + [0] * (16 - len(part)) and index.n_ids[slot] == len(part)
        first = int(np.searchsorted(begins, 16 * g, "right")) - 1
        assert index.first_start[slot] == 16 * g - begins[first] and index.byte_offset[slot] == slot % 8 * 33
        assert order[first] == (None if np.isnan(index.first_doc_id[slot]) else index.first_doc_id[slot])
        assert index.n_docs[slot] == sum(16 * g < e and b < 16 * g + 16 for b, e in zip(begins, begins[1:]))
    later = tokenshards.read_shards(spark, folder, start_slot=11, end_slot=20)
    assert sorted(r["slot"] for r in later.collect()) == list(range(11, 20))


def test_shards_do_not_depend_on_splits(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, many = (tokenshards.write_shards(d, f"file://{tmp_path}/{k}", length=256).toPandas().sort_values("slot").reset_index(drop=True) for k, d in enumerate((docs.coalesce(1), docs.repartition(7))))
    assert one.equals(many)


def test_shards_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], DOCS)
    assert tokenshards.write_shards(none, f"file://{tmp_path}/o").collect() == []
    assert tokenshards.read_shards(spark, f"file://{tmp_path}/o").collect() == []


def test_pieces(spark):
    v = pieces.vocabulary()

    def brute(unit):
        into, out = v.lattice(unit), []

        def go(at, ids, score):
            if at == len(unit):
                out.append((score, ids))
            for end in range(at + 1, len(unit) + 1):
                for s, x, p in into[end]:
                    if s == at:
                        go(end, ids + p, score + x)

        go(0, (), 0.0)
        return sorted(out, reverse=True)

    for unit in ("▁the", "▁hello", "日本x", "▁▁a"):
        assert [s for s, _ in v.search(unit, 4)] == [s for s, _ in brute(unit)[:4]]
    text = "hi to  the\nab 😀"
    ids, scores = v.encode(v.codes_of_texts([text])[0])
    want = brute("▁hi▁to▁▁the\nab▁😀")[:4]
    assert np.allclose(scores, [s for s, _ in want]) and [tuple(i.tolist()) for i in ids] == [i for _, i in want]
    assert all(pieces.decode(i, v) == text for i in ids)


def test_pieces_of_whole_documents(spark):
    """The best list against forward Viterbi over a whole document, the others against an N-best Viterbi."""
    v = pieces.vocabulary()
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("n_chars").limit(40)
    for r in pieces.encode_documents(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        into = v.lattice("▁" + r["text"].replace(" ", "▁"))
        tops = [[(0.0, ())]]
        for edges in into[1:]:
            tops.append(sorted(((s + x, ids + p) for at, x, p in edges for s, ids in tops[at]), key=lambda t: -t[0])[:4])
        assert np.allclose(r["nbest_scores"], [s for s, _ in tops[-1]])
        score = {i: v.score[p] for p, i in v.id.items()}
        for ids, s in zip(r["nbest_ids"], r["nbest_scores"]):
            assert pieces.decode(np.array(ids), v) == r["text"] == r["decoded"]
            assert abs(sum(score.get(i, v.floor) for i in ids) - s) < 1e-6 or set(ids) & set(v.byte.values())
        assert len({tuple(x) for x in r["nbest_ids"]}) == len(r["nbest_ids"]) and r["n_pieces"] == len(r["nbest_ids"][0])


def test_units_on_bytes():
    v = pieces.Vocabulary(None, 4)
    texts = ["", " ", "a", " a", "a ", "a  b", "\n", "a\n", "\na", "a \nb", "a\n b", "a\n\nb", "▁x ▁", "日本 😀\tq\x00z", "x" * 500 + " " + "é" * 100, "a\n \nb  \n c"]
    for t, codes in zip(texts, v.codes_of_texts(texts)):
        assert [v.names[k] for k in codes] == pieces.units_of(t)
        if "▁" not in t:
            assert pieces.decode(v.encode(codes)[0][0], v) == t


def test_decode_column(spark):
    rows = spark.createDataFrame([([],), (None,), ([10**9],), ([None, 3],)], "ids array<int>")
    assert [r["decoded"] for r in pieces.decode_ids(rows).collect()] == ["", None, None, None]


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, "h"), (2, "nothing", "h"), (3, "HTTP://A.Example.com/en/7x?q", "h"), (4, "x://com/en/", "h"), (5, "x://b.io/Casino/1", "h")], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.filter_urls(pages).collect()}
    assert got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[4][2:] == ("com/en/", "block") and got[5][2:] == (None, "block")


def test_many_url_rules(spark):
    hosts = [*urlfilter.HOST_RULES, *((("block", "allow")[k % 2], f"h{k}.org", "/P/") for k in range(50_000)), ("block", "io", ""), ("allow", "b.io", "/Q"), ("block", "é.fr", "/é")]
    rules = urlfilter.rule_rows(spark, hosts, ["bad-word", "spam"])
    urls = ["x://a.h123.org/P/z", "x://h124.org/P/", "x://h124.org/p/", "x://q.io", "x://b.io/Qx", "x://nio/a", "x://é.fr/éa", "x://z/a-Bad-Word", "x://z/bad/word", "x://Z.ORG/es/"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] * 2, "page_id long, url string")
    got = [r for r in urlfilter.filter_urls(pages, rules).collect()]
    assert len(got) == 2 * len(urls)
    at = {r["page_id"]: (r["rule"], r["pattern"], r["verdict"]) for r in got}
    none = (None, None, "allow")
    assert [at[k] for k in range(len(urls))] == [
        ("h123.org/P/", None, "allow"), ("h124.org/P/", None, "block"), none, ("io", None, "block"), ("b.io/Q", None, "allow"), none,
        ("é.fr/é", None, "block"), (None, "bad-word", "block"), none, ("org/es/", None, "block"),
    ]


def test_near_copies_at_the_threshold_are_found(spark):
    """Planted pairs at a similarity of 0.75 to 0.80 among texts that share nothing: none is missed."""
    rng, texts, want = np.random.default_rng(9), [], 0
    for p in range(120):
        words = [f"p{p}w{k}" for k in range(int(rng.integers(80, 200)))]
        n = len(words) - 4
        edits = int(n * 0.125 / 5 * rng.uniform(0.75, 0.98))
        changed = list(words)
        for k in range(edits):
            changed[4 + 10 * k] = f"p{p}new{k}"
        a, b = minhash.exact_shingles(" ".join(words)), minhash.exact_shingles(" ".join(changed))
        want += 0.75 <= len(a & b) / len(a | b) <= 0.85
        texts += [" ".join(words), " ".join(changed)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    for k in range(0, len(texts), 2):
        a, b = minhash.exact_shingles(texts[k]), minhash.exact_shingles(texts[k + 1])
        assert (got[k + 1] == k) == (100 * len(a & b) >= 75 * len(a | b)), k
    assert want >= 60


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [1.0, 0.0], 2), (5, [0.0, 0.0], 1), (6, None, 1), (7, [1.0, float("nan")], 1), (8, [1.0, 0.0], None)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    assert all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8))


def test_pipeline_by_hand(spark, monkeypatch):
    """Each stage against plain Python on its own input; what the run leaves are its pieces alone."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    found = langid.predict(docs, langid.fit(docs)).collect()
    one = langid.stage(spark, docs, SF)
    rows = {r["doc_id"]: r for r in one.collect()}
    assert one.columns == columns and set(rows) == {r["doc_id"] for r in found if r["lang_pred"] != "und" and r["score"] >= langid.MIN_SCORE}
    # lines
    two = linededup.stage(spark, one, SF)
    seen, want = set(), {}
    for i in sorted(rows):
        left, lost = [], 0
        for c in _cut_by_hand(rows[i]["text"]):
            again = "\n" in c and c.strip() and c in seen
            lost += bool(again)
            left += [] if again else [c]
            seen.add(c)
        text = "\n".join(left)
        if not lost or text.strip():
            want[i] = text
    got = {r["doc_id"]: r["text"] for r in two.collect()}
    assert two.columns == columns and got == want and all(len(r["text"]) == r["n_chars"] for r in two.collect() if r["text"] != rows[r["doc_id"]]["text"])
    # near duplicates
    three = minhash.stage(spark, two, SF)
    sets = {i: minhash.exact_shingles(t) for i, t in want.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, x in enumerate(ids):
        for y in ids[k + 1 :]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    want = {i: t for i, t in want.items() if root(i) == i}
    assert three.columns == columns and {r["doc_id"]: r["text"] for r in three.collect()} == want
    # passages
    four = substring.stage(spark, three, SF)
    words = {i: t.encode().split() for i, t in want.items()}
    times = {}
    for w in words.values():
        for k in range(len(w) - substring.TARGET + 1):
            key = tuple(w[k : k + substring.TARGET])
            times[key] = times.get(key, 0) + 1
    after = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - substring.TARGET + 1) if times[tuple(w[k : k + substring.TARGET])] > 1 for j in range(k, k + substring.TARGET)}
        if not gone:
            after[i] = want[i]
        elif len(gone) < len(w):
            after[i] = b" ".join(x for j, x in enumerate(w) if j not in gone).decode()
    assert four.columns == columns and {r["doc_id"]: r["text"] for r in four.collect()} == after
    # the run ends with the pieces of these texts
    monkeypatch.setattr(langid, "fit", lambda d, **_: None)
    monkeypatch.setattr(langid, "predict", lambda d, m: d.join(spark.createDataFrame([(r["doc_id"], r["lang_pred"], r["score"]) for r in found], "doc_id long, lang_pred string, score double"), "doc_id"))
    out = corpus_pipeline.run(spark, SF).collect()
    tokens = {i: len(ids) + 1 for (i, _), ids in zip(after.items(), token_batches(list(after.values())))}
    total = {}
    for r in out:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == tokens


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pieces_solved_together():
    rng = np.random.default_rng(3)
    letters = list("abcdeinst▁éß日\U0001f600Q0.") + ["\ua66e"]  # the last is no piece
    words = ["".join(rng.choice(letters, n)) for n in rng.integers(1, 20, 2000)] + ["a" * 70, "▁the"]
    words = list(dict.fromkeys(words))
    v = pieces.Vocabulary(None, 4)
    codes = dict(zip(words, v.codes_of(words).tolist()))
    whole = v.solve(words)[0]
    assert 500 < whole.sum() < len(words)
    for w in words:
        best, gap, ids = v.part(w)
        k = codes[w]
        assert abs(v.best[k] - best) < 1e-9 and (v.gap[k] == gap or abs(v.gap[k] - gap) < 1e-9)
        got = tuple(v.flat[v.start[k] : v.start[k] + v.length[k]].tolist())
        assert got == ids or gap < 1e-9


def test_fingerprint_reads_every_term_of_the_band(spark):
    words = ["".join(chr(97 + int(c)) for c in f"{k:03d}") for k in range(300)]
    texts = [" ".join(words), *[" ".join(words[:k] + words[k + 1 :]) for k in range(300)], " ".join([*words, "outside"])]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0]), (None, texts[0])], "doc_id long, text string")
    got = fingerprint.fingerprints(docs, rare=0.1, common=1.0).select("doc_id", "fingerprint").collect()
    whole = {r["fingerprint"] for r in got if r["doc_id"] in (0, None, 301)}  # twice, without an id, with a term outside the band
    assert len(got) == 304 and len(whole) == 1
    assert len({r["fingerprint"] for r in got}) == 301


def test_language_learns_beside_a_label_without_letters(spark):
    rows = [(k, ("the cat sat on the mat", "der hund lief durch den wald", " 12 ")[k % 3], ("en", "de", "zxx")[k % 3]) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, steps=100)
    assert model.langs == ["de", "en"]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert all(got[k] == (lang if lang != "zxx" else "und") for k, _, lang in rows)


def _cut_by_hand(text, window=linededup.WINDOW, spacing=linededup.SPACING):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, at = [], 0
    for i in range(len(lines)):
        value = sum(h[i - k] * linededup.powers(window)[k] for k in range(min(window, i + 1)))
        if (value % linededup.PRIME * linededup.FACTOR >> linededup.SHIFT) % spacing == 0 or i == len(lines) - 1:
            out.append("\n".join(lines[at : i + 1]))
            at = i + 1
    return out


def test_language_of_rare_labels_and_junk(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rare = [(10_000 + 3 * k, "крок лимо дарен вушка " * (2 + k), "xx", "s", 1) for k in range(4)]
    junk = [(20_000 + k, t, None, "s", 1) for k, t in enumerate(("xq zj kv wq pj xz qv " * 20, "qzx!!kjv#wq0 " * 30, "12 34 !!", None))]
    null = [(30_000, "der und die einen schlich sich nicht und einer", None, "s", 1)]
    both = docs.unionByName(spark.createDataFrame(rare + junk + null, docs.schema))
    model = langid.fit(both, max_docs=40)
    assert "xx" in model.langs
    got = {r["doc_id"]: r for r in langid.predict(both, model).collect()}
    assert all(got[i]["lang_pred"] == "xx" for i, *_ in rare) and got[20_002]["lang_pred"] == got[20_003]["lang_pred"] == "und"
    assert got[20_000]["score"] < langid.MIN_SCORE > got[20_001]["score"] and len({round(r["score"], 3) for r in got.values()}) > 50
    kept = {r["doc_id"]: r["lang"] for r in langid.stage(spark, both, SF).collect()}
    assert not {i for i, *_ in junk} & set(kept) and kept[30_000] == got[30_000]["lang_pred"]
    assert len(set(kept) & {r["doc_id"] for r in docs.collect()}) >= 0.98 * docs.count()


def test_boundary_depends_on_each_line_of_the_window(spark):
    tail = [f"same {k}" for k in range(linededup.WINDOW - 1)]
    docs = [(k, "\n".join([f"{k}", *tail, "last"])) for k in range(40)]
    got = {r["doc_id"]: r["n_chunks"] for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {k: len(_cut_by_hand(t)) for k, t in docs}
    # a boundary behind the last line but one comes and goes with the first line of its window
    closes = {len(_cut_by_hand(t)[-1].split("\n")) == 1 for _, t in docs}
    assert closes == {True, False} and all(f % 2 for f in linededup.powers(8))


def test_inserted_line_moves_near_boundaries_only():
    lines = [f"line {k}" for k in range(200)]
    before, after = _cut_by_hand("\n".join(lines)), _cut_by_hand("\n".join([*lines[:100], "new", *lines[100:]]))
    same = len(set(before) & set(after))
    assert len(before) > 30 and same >= len(before) - 5


def test_lines_by_hand(spark):
    block = "\n".join(f"shared {k}" for k in range(30))
    texts = [block, "own\n" + block, block, "x", "", None, "\n\n\n\n", "\n\n\n\n", block + "\nend"]
    rows = [(k, t, f"l{k}", k) for k, t in enumerate(texts)] + [(0, block, "l0", 0), (None, block, "n", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __lines string, __gone int").withColumnRenamed("__gone", "gone")
    seen, want = set(), []
    for i, t, name, g in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        chunks = [] if t is None else _cut_by_hand(t)
        left = []
        for c in chunks:
            again = "\n" in c and c.strip() and c in seen
            if not again:
                left.append(c)
            seen.add(c)
        row = (i, None if t is None else "\n".join(left), name, g, len(chunks), len(chunks) - len(left))
        want += [row] * (2 if i == 0 else 1)
    got = [tuple(r) for r in linededup.dedup_lines(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_pieces_of_long_units():
    rng = np.random.default_rng(8)
    v = pieces.Vocabulary(None, 4)
    for letters, n in (("abcdefghijklmnopqrstuvwxyz", 1_000_000), ("ab", 30_000), ("日本語の", 50_000)):
        text = "".join(rng.choice(list(letters), n))
        ids, scores = v.encode(v.codes_of_texts([text])[0])
        assert len(ids) == (4 if letters[0] == "a" else 1) and scores == sorted(scores, reverse=True)  # pieces of one letter each leave one way
        assert all(pieces.decode(i, v) == text for i in ids) and len({i.tobytes() for i in ids}) == len(ids)
    # cut in parts or searched as one: the same scores, all different
    for _ in range(200):
        unit = "".join(rng.choice(list("abcdefghijxqzvwk▁é日"), rng.integers(2, 14)))
        found, whole = v.list_of(unit), v.search(unit, 4)
        assert [round(s, 6) for s, _ in found] == [round(s, 6) for s, _ in whole] and len({i for _, i in found}) == len(found)
