"""Small fixtures against brute force, and the defined results of odd inputs."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from tickwell.llm import boosting, fingerprints, html_text, jaccard_join, language, mixing, packing, pseudo_likelihood, quality, shingles, topk, toxicity, work

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key long"
ODD = [(1, None, None, None, None, 0.0, 1), (2, "", "en", "a", 0, 0.0, 1), (3, " \n\t ", "en", "a", 4, 0.0, 1), (4, "one", "en", "a", 3, 0.0, 1), (4, "one", "en", "a", 3, 0.0, 1), (None, "no id here at all", "en", None, 3, 0.0, 1), (5, "w" * 5000 + " x" * 3000, "en", "b", None, None, None)]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame([r if len(r) == 7 else (*r, "en", "a", 1, 0.0, 1) for r in rows] if schema == DOCS else rows, schema)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def family(rng, n=150):
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    out = {}
    for i in range(n):
        kind = rng.integers(0, 4)
        own = list(base) if kind else [f"u{x}" for x in rng.integers(0, 9000, rng.integers(1, 90))] + base[:14]
        for at in rng.integers(0, len(own), rng.integers(0, 7)):
            own[at] = f"e{rng.integers(0, 9000)}"
        out[i] = " ".join(own[: rng.integers(60, 125)] if kind == 1 else own)
    return out


def test_shingles_agree_with_plain_python():
    texts = ["A b  c\td", "", "  ", "x", "one two three four five six\nseven", "é É Z z", "a b c d e a b c d e a b c d e", "w" * 300 + " v"]
    got = list(shingles.shingle_sets(*shingles.text_buffers(__import__("pyarrow").array([*texts, None]))))
    assert [len(x) for x in got] == [len(shingle_set(t)) for t in texts] + [0]
    assert len(set().union(*[set(x.tolist()) for x in got])) == len(set().union(*map(shingle_set, texts)))
    assert set(shingles.shingle_sets(*shingles.text_buffers(__import__("pyarrow").array(["ONE two"]))).__next__().tolist()) == set(shingles.shingle_sets(*shingles.text_buffers(__import__("pyarrow").array(["one\n TWO "]))).__next__().tolist())


@pytest.mark.parametrize("members", [4, 1024])
def test_jaccard_components_are_exact(spark, monkeypatch, members):
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", members)
    texts = family(np.random.default_rng(members))
    got = {r.doc_id: r for r in jaccard_join.jaccard_components(frame(spark, list(texts.items()))).collect()}
    assert {i: r.component_id for i, r in got.items()} == components(texts)
    assert all(r.n_shingles == len(shingle_set(texts[i])) for i, r in got.items())


def test_sets_with_few_low_hashes_still_meet(spark):
    # Of 8 shared shingles only 5 lies below the cut: x takes 101 and 102 besides, y has 6 and 7 of its own there.
    sets = spark.createDataFrame([(1, 8, [5, 101, 102]), (2, 10, [5, 6, 7])], "key long, n long, shingles array<long>")
    assert [(r.pivot, r.key) for r in jaccard_join.meetings(sets, 75).collect()] == [(1, 2)]


def test_jaccard_components_of_short_supersets(spark):
    texts = {}
    for i in range(400):
        n = 12 + i % 20
        own = [f"p{i}w{k}" for k in range(n + (n - 4) // 4)]
        texts[2 * i], texts[2 * i + 1] = " ".join(own[:n]), " ".join(own)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(frame(spark, list(texts.items()))).collect()}
    assert got == components(texts)


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_components_of_all_small_sizes(spark, seed):
    """Pairs and triples of 1 to 40 shingles at, just under and just over the threshold; the 9-of-12 pair among them."""
    rng = np.random.default_rng(seed)
    texts, at = {}, 0
    for i in range(700):
        n = int(rng.integers(1, 41))
        own = [f"s{seed}p{i}w{k}" for k in range(n + 4)]
        texts[at], at = " ".join(own), at + 1
        for more in ([n // 3, n // 3 + 1] if n > 2 else [0, 1])[: int(rng.integers(1, 3))]:
            cut = int(rng.integers(0, 2))
            texts[at], at = " ".join([*own[cut:], *(f"s{seed}p{i}x{k}" for k in range(max(0, more - cut)))]), at + 1
    texts[at], texts[at + 1] = " ".join(f"n{k}" for k in range(13)), " ".join(f"n{k}" for k in range(16))
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(frame(spark, list(texts.items()))).collect()}
    sets = {i: shingle_set(t) for i, t in texts.items()}
    holders = {}
    for i, own in sets.items():
        for x in own:
            holders.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in sorted({(a, b) for own in holders.values() for a in own for b in own if a < b}):
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in sets} and got[at + 1] == at


def test_shared_folder_is_asked_for_on_a_cluster():
    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        def __init__(self, master):
            self.conf, self.sparkContext = Conf(), type("Context", (), {"master": master})

    one = Session("local[4]")
    assert work.shared_dir(one).startswith("file:///") and work.shared_dir(one) == one.conf["spark.checkpoint.dir"]
    for master in ("local-cluster[3,2,3000]", "spark://host:7077", "yarn"):
        with pytest.raises(ValueError):
            work.shared_dir(Session(master))


def test_voronoi_cells_lose_no_link():
    texts = family(np.random.default_rng(9), 400)
    sets = [np.unique(s) for s in shingles.shingle_sets(*shingles.text_buffers(__import__("pyarrow").array(list(texts.values()))))]
    plain = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert {tuple(sorted(p)) for p in jaccard_join.voronoi_links(sets, 75)} == plain


@pytest.mark.parametrize("words,size", [(60, 40), (4000, 30), (200_000, 300), (10, 0)])
def test_common_counts(words, size):
    rng = np.random.default_rng(words)
    sets = [np.unique(rng.integers(0, words, rng.integers(0, size + 1)).astype(np.uint64)) for _ in range(90)] + [np.zeros(0, np.uint64)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    own = np.array([[words * (i == j) for j in range(91)] for i in range(91)]).astype(bool)
    assert (jaccard_join.common_counts(sets)[~own] == np.array(want)[~own]).all()


def test_jaccard_odd_rows(spark):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard_join.jaccard_components(frame(spark, ODD)).collect())
    assert got == [(-1, 1, -1), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 2, 5)]
    kept = sorted((r.doc_id or -1) for r in jaccard_join.representatives(frame(spark, ODD)).collect())
    assert kept == [-1, 1, 2, 3, 4, 5]
    assert jaccard_join.representatives(frame(spark, ODD)).columns == frame(spark, ODD).columns
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0


def test_fingerprints(spark):
    rng = np.random.default_rng(3)
    texts = {int(i): " ".join(f"w{x}" for x in rng.integers(0, 400, rng.integers(0, 900))) for i in rng.permutation(60)}
    texts[7] = texts[8]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(frame(spark, list(texts.items()))).collect()}
    ids = sorted(texts)
    for i, follow in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, n = texts[i], len(texts[i]) // 4
        edited = t[: len(t) - n] + texts[follow][:n]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingle_set(t), shingle_set(edited)
        assert abs(got[i].near_edited - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
    assert got[7].near_next == 1 and got[7].fingerprint == got[8].fingerprint
    odd = fingerprints.edited_fingerprints(frame(spark, ODD)).collect()
    assert len(odd) == len(ODD) and [r.near_next for r in odd if r.doc_id == 1] == [1.0]
    assert fingerprints.edited_fingerprints(frame(spark, [])).count() == 0
    assert fingerprints.fingerprints(frame(spark, ODD)).count() == len(ODD)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    a, b = np.unique(rng.integers(0, 2**64, 3000, np.uint64)), np.unique(rng.integers(0, 2**64, 3000, np.uint64))
    both = np.union1d(a, b)
    assert (fingerprints.merge(fingerprints.sketch(a), fingerprints.sketch(b)) == fingerprints.sketch(both)).all()
    assert abs(fingerprints.distinct_count(fingerprints.sketch(both)) / len(both) - 1) < 0.3
    assert abs(fingerprints.containment(fingerprints.sketch(a), fingerprints.sketch(both)) - 1) < 0.35
    assert (fingerprints.decode(fingerprints.encode(fingerprints.sketch(a))) == fingerprints.sketch(a)).all()


def duck(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    return con.sql(sql).df()


def same(a, b):
    a, b = (x[sorted(x.columns)].astype(str).sort_values(sorted(x.columns)).reset_index(drop=True) for x in (a, b))
    return a.equals(b)


def test_mixing_agrees_with_sql_and_meets_the_target(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(0, 60)), "en", "big" if i % 3 else f"s{i % 7}", 1, 0.0, 1) for i in range(900)]
    docs = frame(spark, rows)
    got = mixing.mix(docs).select("doc_id", "mix.source", "mix.copy", "mix.tokens", "mix.place").toPandas()
    assert same(got, duck(mixing.SQL, documents=docs.toPandas()))
    tokens = got.groupby("source").tokens.sum()
    w = tokens / tokens.sum()
    assert abs(-(w * np.log(w)).sum() / np.log(len(w)) - mixing.ENTROPY) < 0.02
    assert got.copy is not None and got["copy"].max() >= 1
    ordered = got.sort_values(["place", "source", "doc_id"])
    for i in range(4):  # the weights hold along the way
        stretch = ordered.iloc[i * len(ordered) // 4 : (i + 1) * len(ordered) // 4]
        share = stretch.groupby("source").tokens.sum() / stretch.tokens.sum()
        assert (share.reindex(w.index).fillna(0) - w).abs().max() < 0.12
    assert got.place.between(0, 1).all()
    assert mixing.mix(frame(spark, [])).count() == 0
    odd = mixing.mix(frame(spark, [(1, "a b c", "en", "x", 1, 0.0, 1)] * 4 + [(2, "a b c", "en", "y", 1, 0.0, 1)] * 4)).select("doc_id", "mix.source", "mix.copy").collect()
    assert Counter(r.source for r in odd) == {"x": 4, "y": 4} and {r.copy for r in odd} == {0}  # ties and repeated rows
    assert mixing.mix(frame(spark, ODD)).columns[:-1] == docs.columns
    clash = mixing.mix(docs.toDF("doc_id", "text", "plan", "source", "fit", "copy", "block"))
    assert clash.columns == ["doc_id", "text", "plan", "source", "fit", "copy", "block", "mix"] and clash.count() == len(got)


def test_mixing_repetition_limit(spark):
    docs = frame(spark, [(i, "a b c d", "en", "big" if i else "tiny", 1, 0.0, 1) for i in range(200)])
    got = mixing.mix(docs, entropy=1.0, repetition=3.0).groupBy("mix.source").count().collect()
    assert {r.source: r["count"] for r in got}["tiny"] in (2, 3)


def test_language(spark):
    rng = np.random.default_rng(1)
    make = lambda alphabet: " ".join("".join(rng.choice(list(alphabet), 4)) for _ in range(60))
    rows = [(i, make("abcdef" if i % 2 else "éuvwxyz"), "aa" if i % 2 else "bb", "s", 1, 0.0, 1) for i in range(80)]
    model = language.fit(frame(spark, rows))
    got = language.predict(frame(spark, rows), model).toPandas()
    assert (got.lang_pred == np.where(got.doc_id % 2, "aa", "bb")).all() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    odd = language.predict(frame(spark, [*ODD, (9, "123 !!", "en", "a", 1, 0.0, 1)]), model).toPandas()
    assert (odd.lang_pred == "und").sum() == 4 and len(odd) == len(ODD) + 1
    assert language.predict(frame(spark, ODD), language.fit(frame(spark, []))).where("lang_pred <> 'und'").count() == 0
    foreign = language.accepted(frame(spark, [(1, make("ghijklmnopqrst") * 5), rows[0]]), model)
    assert [r.doc_id for r in foreign.collect()] == [0]


def plain_ngrams(text):
    raw = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in text.lower().encode())
    out = Counter(b for b in raw if b != 32)
    for n in (2, 3):
        for i in range(len(raw) - n + 1):
            g = raw[i : i + n]
            if g[:2] != b"  " and g[-2:] != b"  ":
                out[(int.from_bytes(g, "big") * 0x9E3779B1 >> 7) % (language.DIMENSIONS - 256) + 256] += 1
    return out


def test_language_agrees_with_brute_force():
    rng = np.random.default_rng(2)
    texts = ["\u00e9tait l'ami", "a", "the cat  sat, on 12 mats", "Z" * 50, *["".join(rng.choice(list("abc \u00e9x,"), 80)) for _ in range(20)]]
    counts = np.concatenate(list(language.ngram_counts(__import__("pyarrow").array(texts))))
    for text, row in zip(texts, counts, strict=True):
        assert {k: v for k, v in enumerate(row.tolist()) if v} == dict(plain_ngrams(text))
    idf = 1 + rng.random(language.DIMENSIONS)
    centroids = rng.random((3, language.DIMENSIONS))
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    radius = np.sort(rng.uniform(0.6, 1, (3, language.LENGTHS)))[:, ::-1]
    found, score, rejected = language.Model(idf, centroids.astype(np.float32), radius, ["x", "y", "z"]).predict(__import__("pyarrow").array(texts))
    for text, name, s, r in zip(texts, found, score, rejected, strict=True):
        own = plain_ngrams(text)
        norm = sum((v * idf[k]) ** 2 for k, v in own.items()) ** 0.5
        cosine = [sum(v * idf[k] * c[k] for k, v in own.items()) / norm for c in centroids]
        best = int(np.argmax(cosine))
        assert name == "xyz"[best] and abs(s - cosine[best]) < 1e-4 and r == (1 - s > radius[best][len(own).bit_length() - 1])


def test_language_rejects_what_it_never_learnt_and_keeps_the_rest(spark):
    rng = np.random.default_rng(3)
    make = lambda alphabet, n: " ".join("".join(rng.choice(list(alphabet), 4)) for _ in range(n))
    sizes = [6, 30, 200, 900, 20_000]
    rows = [(i, make("abcdefgh" if i % 2 else "pqrstuvw", sizes[i % 4]), "aa" if i % 2 else "bb", "s", 1, 0.0, 1) for i in range(400)]
    model = language.fit(frame(spark, rows))
    assert language.accepted(frame(spark, rows), model).count() >= 396
    assert language.accepted(frame(spark, [(i, make("ijklmnoxyz", n)) for i, n in enumerate(sizes)]), model).count() == 0
    assert [r.doc_id for r in language.accepted(frame(spark, [rows[0], rows[0]]), model).collect()] == [0, 0]
    assert language.fit(frame(spark, [(1, None), (None, "a b"), (3, "12", None, "s", 1, 0.0, 1)])).language == []


def test_boosting_learns_and_flat_trees_agree_with_plain_ones():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = boosting.fit(x[:400], y[:400])
    assert ((model.score(x[400:]) >= 0.5) == y[400:]).mean() > 0.93

    def plain(row):
        total = model.prior
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            total += v[at - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x[:20]), [plain(r) for r in x[:20]])
    assert model.score(x[:0]).shape == (0,)


def test_quality(spark):
    rng = np.random.default_rng(2)
    good = lambda: " ".join(f"word{x}" for x in rng.integers(0, 500, 80)) + "."
    rows = [(i, good() if i % 2 else "junk*** " * 60, "en", "s", 1, 0.0, 1) for i in range(90)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (61, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(frame(spark, rows), labels)
    got = quality.score(frame(spark, rows), model).toPandas()
    assert (got.predicted == got.doc_id % 2).all() and (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert quality.score(frame(spark, ODD), model).where("score BETWEEN 0 AND 1").count() == len(ODD)
    assert {r.doc_id % 2 for r in quality.accepted(frame(spark, rows), model).collect()} == {1}
    assert quality.score(frame(spark, ODD), quality.fit(frame(spark, []), labels)).where("score = 0.5").count() == len(ODD)


def test_packing(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path(packing.VOCABULARY))
    rows = [(i, t) for i, t in enumerate(["Hello, World's 12 ½ things", "", None, "naïve  café’s “x” 日本", "<|endoftext|> a", "word " * 700, "İSTANBUL ΣΑΣ", *[f"text number {i} " * (i % 40) for i in range(80)]])]
    got = packing.pack(frame(spark, rows), window=256).toPandas()
    whole = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    for r in got.itertuples():
        assert np.frombuffer(r.ids, "<u4").tolist() == whole[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(whole[r.doc_id])
    assert got.groupby("doc_id").length.sum().to_dict() == {i: len(x) for i, x in whole.items()}
    ordered = got.sort_values(["sequence_id", "offset"])
    full = ordered.groupby("sequence_id").length.sum()
    assert (full.iloc[:-1] == 256).all() and (ordered.sequence_id * 256 + ordered.offset == ordered.length.cumsum().shift(1, fill_value=0)).all()
    assert packing.digests(packing.pack(frame(spark, ODD))).count() >= len(ODD)
    assert packing.pack(frame(spark, [])).count() == 0


def test_every_plain_character_is_encoded_as_the_tokenizer_does():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path(packing.VOCABULARY)
    signs = [*map(chr, [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x203B), 0x20AC])]
    texts = [x for c in signs for x in (c, f"ab{c}cd", f"{c}word", f"word{c} x", f" {c} ", f"A{c}")]
    rng = np.random.default_rng(0)
    letters = [*signs, *("abcdefghij ETA  " * 30), *(["'s", "'ll", "'T"] * 10)]
    texts += ["".join(rng.choice(letters, int(rng.integers(1, 14)))) for _ in range(20_000)] + ["\u0190dzi \u0186kwan \u0181aawo"]
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [t for t, g, w in zip(texts, packing.encoder(path)(texts), want, strict=True) if np.frombuffer(g, np.uint16).tolist() != w.ids] == []


def test_packing_follows_the_files(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    rows = [(i, f"text number {i} " * (i % 40)) for i in range(300)]
    frame(spark, rows).orderBy("doc_id").repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/docs")
    got = []
    for size in ("128m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got.append(packing.digests(packing.pack(spark.read.parquet(f"{tmp_path}/docs"), window=64)).toPandas().sort_values(["sequence_id", "offset"]).reset_index(drop=True))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got[0].equals(got[1]) and got[0].doc_id.drop_duplicates().tolist() == list(range(300))


def test_html(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a> Site</header><nav><ul><li><a href=a>One</a></li></ul></nav>
    <script>var x = "<p>no</p>";</script><!-- <p>no</p> --><article><h1>Head &amp; line</h1><p>First   para <b>bold</b> &lt;x&gt; with words
    enough.<p>Second para.<div class="share-box">Share this now</div><div id="comments"><p>Nice article, thanks a lot for writing it down.</p></div></article>
    <aside>Read also this</aside><form><input>Your mail<button>Go</button></form><div class="ad-banner">Buy it, it is cheap today</div><footer>&copy; Us</footer></body></html>"""
    pages = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 1), (3, "u", "", 1), (4, "u", "<p>broken <a href='x'>link <b>" + "many words here " * 20, 1)], "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got[1] == "Head & line\nFirst para bold <x> with words enough.\nSecond para."
    assert got[2] == got[3] == "" and len(got) == 4
    assert html_text.extract(pages.limit(0)).count() == 0
    twice = html_text.extract(pages.unionByName(pages)).collect()
    assert len(twice) == 8 and {r.text for r in twice if r.page_id == 1} == {got[1]}


#: Pages and their main text, marked by hand.
MARKED = [
    ("<article><h1>Ports</h1><section class='social-history'><p>Long ago.</p><p>Boats came.</p></section><form class='x'>Mail</form></article>", "Ports\nLong ago.\nBoats came."),
    ("<nav><a href=/>Home</a></nav><article><p>Only one line", "Only one line"),
    ("<div class='has-sidebar menu'><article class='post'><h1>T &eacute;</h1><p>One&nbsp;two<br>three</p><p><a href=x>A source</a></p><p>End.</article></div>", "T \u00e9\nOne two\nthree\nA source\nEnd."),
    ("<main><p>Words of the page go here.</p><div class='alert notice'>The notice is rather long, " + "yes indeed " * 20 + "</div><p>And here.</p></main>", "Words of the page go here.\nAnd here."),
    ("<div><a href=a>One</a></div><div><a href=b>Two three</a></div><h1>The head of it</h1><div>" + "some plain words of text " * 8 + "</div><div>" + "more of the words " * 9 + "</div><div><a href=c>Read this too now</a></div><div><a href=d>And this one</a></div>",
     "The head of it\n" + ("some plain words of text " * 8).strip() + "\n" + ("more of the words " * 9).strip()),
    ("<article><p>Text of it.</p><aside>Aside</aside><div hidden>Gone</div><div class='comments'><article class='comment'><p>" + "I think that " * 30 + "</p></article></div></article>", "Text of it."),
    ("<script>if (a < b) { x = '<p>no</p>' }</script><style>p { }</style><footer>All rights</footer>", ""),
]


@pytest.mark.parametrize("page,text", MARKED)
def test_html_main_text_of_marked_pages(page, text):
    assert html_text.main_text(page, html_text.trained()) == text


def test_html_numbers_of_words_and_links_decide():
    tree, rng = html_text.trained(), np.random.default_rng(0)
    x, y = html_text.labelled()
    assert (tree.predict(x) == (y > 0.5)).mean() > 0.97
    mixed = x.copy()
    for f in range(6):  # words and link densities of the block and its neighbours
        mixed[:, f] = rng.permutation(mixed[:, f])
    assert (tree.predict(mixed) == (y > 0.5)).mean() < 0.85
    found = html_text.blocks(MARKED[4][0])
    assert not any(b.named or b.element != 1 for b in found)
    flat = html_text.features(found)
    shuffled = flat.copy()
    shuffled[:, :6] = flat[rng.permutation(len(flat)), :6]
    assert (tree.predict(flat) != tree.predict(shuffled)).any()


def test_html_very_long_page():
    page = "<nav>" + "<a href=/>x</a> " * 20_000 + "</nav><article>" + "<p>some words of a paragraph &amp; more</p>" * 20_000 + "</article>"
    assert html_text.main_text(page, html_text.trained()) == "\n".join(["some words of a paragraph & more"] * 20_000)


def test_pseudo_likelihood(spark):
    net = pseudo_likelihood.start(np.sort(np.array([5, 9, 1 << 40], np.uint64)))
    classes, counts = np.array([1, 2, 3, 100, 2]), np.array([3, 0, 2])
    context = pseudo_likelihood.contexts(classes, counts)
    assert context.T.tolist() == [[0, 0, 2, 3], [0, 1, 3, 0], [1, 2, 0, 0], [0, 0, 2, 0], [0, 100, 0, 0]]
    logits = np.tanh(net.inner_bias + sum(net.inner[k][context[k]] for k in range(4))) @ net.outer + net.outer_bias
    plain = (logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)))[np.arange(5), classes]
    assert np.allclose(net.log_probability(context, classes), plain, atol=1e-4)
    rows = [(i, "the cat sat on the mat and the dog ran " * 30) for i in range(40)]
    docs = frame(spark, [*rows, (99, "mat the dog and cat the ran on sat the " * 30)])
    net = pseudo_likelihood.fit(frame(spark, rows), rounds=6, stride=2)
    got = {r.doc_id: r for r in pseudo_likelihood.score(docs, net).collect()}
    assert got[0].mean_log_probability > -1 > got[99].mean_log_probability and got[0].n_words == 300
    odd = pseudo_likelihood.score(frame(spark, ODD), net).toPandas()
    assert len(odd) == len(ODD) and odd[odd.n_words == 0].mean_log_probability.isna().all()
    assert pseudo_likelihood.score(frame(spark, []), pseudo_likelihood.fit(frame(spark, []))).count() == 0


def test_pseudo_likelihood_learns_from_every_word(spark):
    rows = [(i, "a b b b b b b b " * 40) for i in range(40)]  # every 8th word alone shows only a
    got = pseudo_likelihood.score(frame(spark, rows), pseudo_likelihood.fit(frame(spark, rows))).collect()
    assert min(r.mean_log_probability for r in got) > -1.5


def test_pseudo_likelihood_tells_the_words_of_a_bucket_apart(spark, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "FREQUENT", 0)
    names = [f"w{i}" for i in range(400)]
    hashes = pseudo_likelihood.word_hashes(*shingles.text_buffers(__import__("pyarrow").array([" ".join(names)])))[0]
    of = dict(zip(names, pseudo_likelihood.buckets(hashes).tolist(), strict=True))
    often, once, new = [w for w in names if of[w] == of["w0"]][:3]
    docs = [(1, f"{often} {often} {often} {once} w1 w1 w2"), (2, often), (2, often), (3, once), (4, new)]
    net = pseudo_likelihood.fit(frame(spark, docs[:1]))
    assert net.totals.sum() == 7 and net.totals[of[often]] >= 4
    got = {r.doc_id: r.log_probability for r in pseudo_likelihood.score(frame(spark, docs), net).collect()}
    assert len(got) == 4 and got[3] == got[4] and abs(got[2] - got[3] - np.log(3)) < 1e-6
    bare = pseudo_likelihood.score(frame(spark, docs), pseudo_likelihood.replace(net, totals=None, words=None, common=net.common[:0]))
    plain = {r.doc_id: r.log_probability for r in bare.collect()}
    assert abs(got[3] - plain[3] + np.log(net.totals[of[once]] + 1)) < 1e-6


@pytest.mark.parametrize("common", [0, 3, 1 << 18])
def test_pseudo_likelihood_agrees_with_brute_force(spark, monkeypatch, common):
    for name, value in (("FREQUENT", 4), ("COMMON", common), ("SHARD_WORDS", 300)):
        monkeypatch.setattr(pseudo_likelihood, name, value)
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 60) if x < 80)) for i in range(30)]
    docs += docs[:2] + [(70, docs[3][1]), (80, "unseen words here"), (90, ""), (91, None)]
    net = pseudo_likelihood.fit(frame(spark, docs[:-4]))
    got = {r.doc_id: r for r in pseudo_likelihood.score(frame(spark, docs), net).collect()}
    times = Counter(w for _, t in docs[:-4] for w in t.split())
    hashed = lambda w: pseudo_likelihood.word_hashes(*shingles.text_buffers(__import__("pyarrow").array([w])))[0]
    frequent = net.frequent.tolist()
    assert common < 4 or sorted(map(int, frequent)) == sorted(int(hashed(w)[0]) for w, _ in sorted(times.items(), key=lambda x: (-x[1], hashed(x[0]).view(np.int64)[0]))[:4])
    first_bucket = len(net.outer_bias) - pseudo_likelihood.BUCKETS
    of = {w: int(net.classes(hashed(w))[0]) for _, t in docs for w in (t or "").split()}
    total = Counter()
    for w, n in times.items():
        total[of[w]] += n

    for i, text in docs:
        own, want = [of[w] for w in (text or "").split()], 0.0
        for at, w in enumerate((text or "").split()):
            near = [own[at + k] if 0 <= at + k < len(own) else 0 for k in pseudo_likelihood.AROUND]
            logits = np.tanh(net.inner_bias + sum(net.inner[k][c] for k, c in enumerate(near))) @ net.outer + net.outer_bias
            want += logits[own[at]] - np.log(np.exp(logits).sum())
            if own[at] >= first_bucket:
                want += np.log(max(1, times[w]) / (total[own[at]] + 1))
        assert got[i].n_words == len(own) and abs(got[i].log_probability - want) < 1e-3 * (1 + len(own))


def test_pseudo_likelihood_does_not_depend_on_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "SHARD_WORDS", 500)
    rng = np.random.default_rng(6)
    docs = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 50) if x < 200)) for i in range(60)]
    one, other = (pseudo_likelihood.fit(frame(spark, rows).repartition(n)) for rows, n in ((docs, 1), (docs[::-1], 7)))
    assert np.allclose(one.flat(), other.flat(), atol=1e-6)


def test_pseudo_likelihood_classes_grow_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "WORDS", 100)
    rows = [(i, " ".join(f"w{j}" for j in range(400))) for i in range(2)]
    net = pseudo_likelihood.fit(frame(spark, rows))
    assert len(net.frequent) == pseudo_likelihood.FREQUENT + 3 * pseudo_likelihood.MORE
    assert len(net.outer_bias) == 1 + len(net.frequent) + pseudo_likelihood.BUCKETS


def string_kernel(a, b):
    """By the definition: every pair of equal subsequences of three symbols, word ends included, that stretch over SPAN symbols at most."""

    def weights(word):
        own, out = ["^", *word, "$"], Counter()
        for i in range(len(own)):
            for j in range(i + 1, len(own)):
                for k in range(j + 1, min(i + toxicity.SPAN, len(own))):
                    out[own[i], own[j], own[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x, y = weights(a), weights(b)
    return sum(v * y[k] for k, v in x.items()) / (toxicity.norms(np.array(len(a) + 2)) * toxicity.norms(np.array(len(b) + 2)))


def test_subsequence_kernel_is_that_of_the_definition():
    names = ["idiot", "idxiot", "theory", "id", "abcabcabc", "a" * 40]
    stream, begin, _ = toxicity.words_of(names)
    table = np.random.default_rng(0).random(toxicity._BASE**3).astype(np.float32)
    explicit = toxicity.word_table(stream, begin)
    for word, own, value in zip(names, explicit, toxicity.word_sums(stream, begin, table), strict=True):
        assert np.isclose((own * table).sum(), value, rtol=1e-3)
        got = toxicity.word_sums(stream, begin, own)
        assert np.allclose(got, [string_kernel(other, word) for other in names], rtol=1e-3)
    assert toxicity._distinct("i d i o t a-b, c!") == ["ab", "c", "idiot"]
    squares = [sum((d - 1) * toxicity.DECAY ** (2 * (d + 1)) for i in range(n) for d in range(2, toxicity.SPAN) if i + d < n) for n in (3, 9, 50)]
    assert np.allclose(toxicity.norms(np.array([3, 9, 50])), np.sqrt(squares))


def test_sentences():
    assert toxicity.sentences("one two. three four! five\nsix i. d. i. o. t. seven") == [["one", "two"], ["four", "three"], ["five", "idiot", "seven", "six"]]
    assert toxicity.sentences("") == toxicity.sentences(" . ! ") == []
    worth = np.array([0.0, 1.0, 5.0, 2.0])
    assert toxicity._worst([np.array([0, 1]), np.zeros(0, np.int64), np.array([3, 2])], worth) == 2


@pytest.mark.parametrize("case", ["no clean words", "nearly all toxic", "a toxic text without words", "no toxic words", "nothing at all", "ties"])
def test_toxicity_learns_from_odd_labels(spark, case):
    word = lambda i: " ".join(f"{'abcdefgh'[i % 8]}{'xyzuvw'[i % 6]}{c}" for c in ("ona", "tree", "lib", "mok"))
    rows, labels = [(i, f"{word(i)} nitwit. {word(i + 1)}" if i % 2 else word(i)) for i in range(60)], [(i, 1, i % 2) for i in range(60)]
    if case == "no clean words":
        rows = [(i, t if i % 2 else "") for i, t in rows]
    if case == "nearly all toxic":
        labels = [(i, 1, int(i != 2)) for i in range(60)]
    if case == "a toxic text without words":
        rows = [(i, " \n 12" if i in (1, 3) else t) for i, t in rows]
    if case == "no toxic words":
        rows = [(i, "" if i % 2 else t) for i, t in rows]
    if case == "nothing at all":
        rows = [(i, None) for i, _ in rows]
    if case == "ties":
        rows, labels = rows + rows, labels + labels
    got = toxicity.score(frame(spark, rows), toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    if case in ("no clean words", "ties"):
        assert (got.predicted == got.doc_id % 2).all()


def test_toxicity(spark):
    rng = np.random.default_rng(4)
    clean = lambda: " ".join(rng.choice(["house", "tree", "water", "green", "river", "stone", "cloud", "paper"], 40))
    rows = [(i, clean() + (" " + str(rng.choice(["blockhead", "nitwit", "scoundrel"])) + " " + clean() if i % 2 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)] + [(201, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame(spark, rows), labels)
    got = toxicity.score(frame(spark, rows), model).toPandas()
    assert (got.predicted == got.doc_id % 2).mean() > 0.99
    bent = toxicity.score(frame(spark, [(1, "water bloockhead tree"), (2, "n.i.t.w.i.t"), (3, "n i t w i t river"), (4, "river water")]), model).toPandas().sort_values("doc_id")
    assert bent.predicted.tolist() == [1, 1, 1, 0]
    odd = toxicity.score(frame(spark, ODD), model).toPandas()
    assert len(odd) == len(ODD) and odd.score.between(0, 1).all() and (odd[odd.doc_id == 1].predicted == 0).all()
    assert toxicity.score(frame(spark, ODD), toxicity.fit(frame(spark, []), labels)).where("predicted = 1").count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(6)
    vectors = [(int(i), [float(x) for x in np.round(rng.normal(size=8), 1)], 0) for i in range(300)]
    vectors += [(300, None, 0), (301, [1.0, None] * 4, 0), (302, [float("nan")] * 8, 0), (303, [float("inf")] * 8, 0), (304, [], 0), (350, [0.0] * 8, 0), (306, [0.0] * 8, 0), (None, [1.0] * 8, 0)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, rank int")
    v = topk.integer_vectors(table, "vec_id", "embedding")
    got = topk.top_k(v.where("id % 50 = 0"), v, 5).toPandas()
    good = {i: np.floor(256 * np.array(e, np.float32).astype(float)).astype(int) for i, e, _ in vectors if i is not None and e and all(x is not None and np.isfinite(x) for x in e)}
    for q in (i for i in good if i % 50 == 0):
        best = sorted(((-int(good[q] @ good[c]), c) for c in good if c != q))[:5]
        own = got[got.query_id == q].sort_values("rank")
        assert list(zip(-own.score, own.vec_id, strict=True)) == best and own["rank"].tolist() == [1, 2, 3, 4, 5]
    assert topk.top_k(v, v.limit(0), 5).count() == 0 and topk.top_k(v.limit(0), v, 5).count() == 0


def test_top_k_repeated_ids_and_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    rng = np.random.default_rng(7)
    rows = [(int(i) // 2 * 2, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(120)] + [(0, [1.0, 1.0, 0.0, 0.0])] * 3 + [(100, [1.0, 2.0, 3.0])] * 2
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = topk.integer_vectors(table, "vec_id", "embedding")
    got = topk.top_k(v.where("id % 50 = 0"), v, 5).toPandas()
    want = duck(topk.SQL, embeddings=pd.DataFrame(rows, columns=["vec_id", "embedding"]))
    key = ["query_id", "rank", "vec_id", "score"]
    assert got[key].sort_values(key).astype(int).values.tolist() == want[key].sort_values(key).astype(int).values.tolist()


@pytest.mark.parametrize("dims,spread", [(4, 1.0), (64, 0.5)])
def test_the_threshold_cuts_where_there_is_structure(dims, spread):
    rng = np.random.default_rng(8)
    turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]  # the structure lies across the given dimensions
    v = np.floor(256 * (rng.normal(size=(6000, dims)) * spread ** np.arange(dims)) @ turn).astype(np.int64)
    best = topk.Best(v[:40], 6)
    for i in range(0, 6000, 2000):
        topk.search(v[i : i + 2000], np.arange(i, min(i + 2000, 6000)), best)
    scores = v[:40] @ v.T
    for q in range(40):
        order = np.lexsort((np.arange(6000), -scores[q]))[:6]
        assert best.ids[q].tolist() == order.tolist() and best.score[q].tolist() == scores[q][order].tolist()
    assert best.scored < 0.6 * scores.size


def test_oracles_on_the_smallest_table(spark):
    rng = np.random.default_rng(8)
    docs = pd.DataFrame(list(family(rng, 90).items()), columns=["doc_id", "text"])
    got = jaccard_join.jaccard_components(spark.createDataFrame(docs)).toPandas()
    assert same(got, duck(jaccard_join.SQL, documents=docs))
    assert Counter(got.component_id).most_common(1)[0][1] > 1
