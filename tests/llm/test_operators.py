"""Operators against brute force, round trips and held-out accuracy, with odd rows."""

import random

import public_tokenizers
import pytest

from lexspan.llm import fingerprints, html_text, jaccard, language, licenses, packing, sentencepiece_bpe, token_counts, tokenize, toxicity, vector_dedup
from lexspan.llm.common import scratch_path

ODD = ["", " ", "a", "  two  spaces ", "tab\tline\n\nend\n", "\x1c\x85 odd", "<|endoftext|> x", "é́字😀▁ ▁▁", "x" * 5000, "ab " * 4000, "İΣ 1.5 don't"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_cached_tokenizers_agree_with_the_library():
    import numpy as np

    ids = tokenize.word_ids(public_tokenizers.path("word_bpe_49k.json"))
    for t, got in zip(ODD, ids.batch(ODD), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids.tok.encode(t, add_special_tokens=False).ids
    counts = tokenize.byte_counts(public_tokenizers.path("byte_bpe_50k.json"))
    assert counts.batch(ODD) == [len(counts.tok.encode(t, add_special_tokens=False).ids) for t in ODD]


def test_token_counts_with_a_kept_cache(spark):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "cache")
    rows = docs(spark, [*ODD, None, "a", "a"])
    first = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(rows, path, cache).collect()}
    assert first[len(ODD)] == 0 and first == {r.doc_id: r.n_tokens for r in token_counts.count_tokens(rows, path, cache).collect()}
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len(set(ODD))


def test_sentencepiece_is_exact():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.model(path)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(list("  aeinst.,'0é字▁\n") + ["the", "   "]) for _ in range(rng.randrange(40))) for _ in range(500)]
    for t in texts:
        ids = lib.encode(t) + [lib.eos_id()]
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids)


def test_packing_holds_every_piece_once(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(docs(spark, [*ODD, None, "word " * 900, "word " * 900]), path, capacity=512).collect()
    by_bin = {}
    for r in rows:
        assert 0 < r.length <= 512
        by_bin.setdefault(r.sequence_id, []).append(r)
    for b in by_bin.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    assert len(by_bin) <= -(-sum(r.length for r in rows) // 512) + 1


def test_local_search_empties_a_bin():
    lengths = [6, 4, 3, 3, 3]  # 6+4 is full only by luck of order: three bins become two
    got = packing.local_search([[0, 2], [1, 3], [4]], lengths, 10)
    assert sorted(i for b in got for i in b) == [0, 1, 2, 3, 4] and len(got) == 2


def test_local_search_looks_at_hundreds_of_underfull_bins():
    rng = random.Random(1)
    lengths = [rng.randint(500, 2600) for _ in range(3_000)]
    bins = packing.best_fit(lengths, 4096)
    assert sum(sum(lengths[i] for i in b) < 4096 for b in bins) > 500
    got = packing.local_search(bins, lengths, 4096)
    assert sorted(i for b in got for i in b) == list(range(3_000)) and all(sum(lengths[i] for i in b) <= 4096 for b in got)
    assert len(got) == -(-sum(lengths) // 4096)  # as few as the total allows


def test_local_search_against_exhaustive_packing():
    rng = random.Random(4)

    def fewest(lengths, capacity):
        best = len(lengths)

        def place(i, fills):
            nonlocal best
            if len(fills) >= best:
                return
            if i == len(lengths):
                best = len(fills)
                return
            for k in range(len(fills)):
                if fills[k] + lengths[i] <= capacity and fills[k] not in fills[:k]:
                    place(i + 1, [*fills[:k], fills[k] + lengths[i], *fills[k + 1 :]])
            place(i + 1, [*fills, lengths[i]])

        place(0, [])
        return best

    more = emptied = 0
    for _ in range(60):
        lengths = [rng.randint(1, 12) for _ in range(9)]
        first = packing.best_fit(lengths, 16)
        got = packing.local_search([list(b) for b in first], lengths, 16)
        assert sorted(i for b in got for i in b) == list(range(9)) and all(sum(lengths[i] for i in b) <= 16 for b in got)
        more += len(got) - fewest(lengths, 16)
        emptied += len(first) - len(got)
    assert more <= 3 and emptied >= 5, (more, emptied)


def test_jaccard_boundary_moves_with_the_data(spark):
    # Short texts made of a few frequent shingles alone are cheaper as subsets; texts of rare ones as lists.
    import itertools

    rng = random.Random(6)
    stock = ["aa bb cc dd ee ff gg hh", "ii jj kk ll mm nn oo pp", "qq rr ss tt uu vv ww xx", "a1 b1 c1 d1 e1 f1 g1 h1"]
    frequent = [" ".join(p) for p in itertools.permutations(stock) for _ in range(40)]
    rare = [" ".join(f"r{rng.randrange(10**9)}" for _ in range(30)) for _ in range(300)]

    def chosen(texts):
        frame = docs(spark, texts)
        heavy = jaccard.heavy_shingles(frame, 4)
        sets = jaccard.describe_sets(frame, 4, 85, 100, heavy).where("n > 0")
        return jaccard.boundary(sets)

    assert chosen(rare) == 5 < chosen(frequent)
    texts = frequent[::20] + rare[:20]
    words = [t.split() for t in texts]
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in words]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((parent[i], parent[j]))
                parent = [a if p == b else p for p in parent]
    got = {r.doc_id: r for r in jaccard.similar_groups(docs(spark, texts), 4, 85, 100).collect()}
    assert [got[i].component_id for i in range(len(texts))] == parent and [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]


def test_jaccard_against_brute_force(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(rng.randrange(4, 60))] for _ in range(25)]
    texts = [None, "", " ", "one two", "one two"]
    for words in base:
        for _ in range(5):
            w = list(words)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "z%d" % rng.randrange(9)
            texts.append(" ".join(w))
    sets = [set(jaccard.shingle_set(t, 4).tolist()) for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((parent[i], parent[j]))
                parent = [a if p == b else p for p in parent]
    got = {r.doc_id: r for r in jaccard.similar_groups(docs(spark, texts), 4, 85, 100).collect()}
    assert [got[i].component_id for i in range(len(texts))] == parent
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]


def test_license_phrases_and_templates():
    scan = licenses.Scanner().scan
    got = scan("Released under the MIT License. Apache license, MIT-license!")
    assert (got["n_base"], got["base_labels"], got["first_word"], got["last_word"]) == (3, "apache,mit", 3, 7)
    assert scan("x Licensed under CC BY-NC 4.0. y")["labels"] == "cc-by-nc"
    assert scan("the terms and conditions of nothing at all")["labels"] == "" and scan(None)["n_words"] == 0
    both = licenses.Scanner({"a": ["one two three four five six seven eight"], "b": ["one two three four nine ten eleven twelve"]}).scan
    assert both("one two three four xx nine ten eleven twelve")["labels"] == "b"
    assert licenses.Scanner({"a": ["one two three four"], "b": ["one two three four"]}).scan("one two three four")["labels"] == "a,b"


def test_bodies_without_their_opening_are_labelled():
    from lexspan.llm import licence_texts

    scan = licenses.Scanner().scan
    for label, clauses in licence_texts.CLAUSES.items():
        assert label in scan("Some words before. " + clauses[-1] + " And after.")["labels"].split(","), label


def test_base_places_against_brute_force():
    rng = random.Random(8)
    words = ["mit", "license", "apache", "general", "public", "x"]
    scanner = licenses.Scanner()
    for _ in range(200):
        text = [rng.choice(words) for _ in range(rng.randrange(30))]
        want = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(text)) if text[i : i + len(p.split())] == p.split())
        assert scanner.base([w.encode() for w in text]) == want


def test_matches_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 14))] for _ in range(4)]
        text = [rng.choice([-1, 0, 1, 2, 0, 1, 2]) for _ in range(30)]
        want = []
        for k, s in enumerate(sequences):
            for i in range(len(text)):
                for j in range(len(s)):
                    if i == 0 or j == 0 or text[i - 1] != s[j - 1]:
                        n = 0
                        while i + n < len(text) and j + n < len(s) and text[i + n] == s[j + n]:
                            n += 1
                        if n >= 2:
                            want.append((i, n, k, j))
        assert licenses.SuffixAutomaton(sequences).maximal_matches(text, 2) == sorted(want)


def test_fingerprints(spark):
    rows = docs(spark, [None, "", "one", "a b c d e f g h i j", "a b c d e f g h i j", "k l m n o p q r s t u v"])
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(rows).collect()}
    assert len(got) == 6 and got[3].fingerprint == got[4].fingerprint and got[4].near_next == 1.0
    assert got[5].near_next == 0.0 and got[0].n_chars == 0
    assert got[2].edited_sha256 == __import__("hashlib").sha256(b"on").hexdigest()  # the next text is empty


def test_language_and_toxicity_learn():
    texts = ["the cat and the dog %d" % i for i in range(40)] + ["der hund und die katze %d" % i for i in range(40)]
    model = language.fit(texts, ["en"] * 40 + ["de"] * 40, [i % 5 == 0 for i in range(80)])
    assert model.predict("the dog and the bird")[0] == "en" and model.predict("die katze und der vogel")[0] == "de"
    assert model.predict(None) == model.predict("123") == model.predict("½ ² Ⅷ ①") == ("und", 0.0)
    clean = ["w%d v%d u%d" % (i, i % 7, i % 11) for i in range(200)]
    bad = [t + " nasty word%d" % (i % 5) for i, t in enumerate(clean[:40])]
    chain = toxicity.fit(clean + bad, [False] * 200 + [True] * 40)
    assert chain.score(toxicity.tokens("a nasty b")) > 0.5 > chain.score(toxicity.tokens("a b c"))
    assert [("nasty")] == ["A Nasty b"[s[0] : s[1]].lower() for s in chain.spans("A Nasty b")]
    assert 0 <= chain.score([]) < 0.5


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(docs.where(~language.held_out()))
    asked = docs.where(language.held_out()).where("lang is not null and text rlike '[a-z]'")
    got = language.identify(asked, model).join(asked.select("doc_id", "lang"), "doc_id")
    right, n = got.where("lang = lang_pred").count(), got.count()
    assert n > 200 and right >= 0.97 * n, right / n


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    chain = toxicity.train(docs, labels.where(~toxicity.held_out()))
    asked = docs.join(labels.where(toxicity.held_out() & (labels.toxic.isNotNull())), "doc_id")
    got = toxicity.score_toxicity(asked, chain).join(labels, "doc_id").selectExpr("toxic", "int(score >= 0.5) as said").groupBy("toxic", "said").count().collect()
    n = {(r.toxic, r.said): r["count"] for r in got}
    assert n[1, 1] >= 0.88 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.03 * (n[0, 0] + n.get((0, 1), 0)), n


def test_toxicity_trains_every_marked_token():
    # The toxic rows come after more than 6,000 clean ones; "fifth" is always the fifth marked place of its row.
    clean = ["w%d v%d" % (i, i % 7) for i in range(6_500)]
    gap = " q" * 20
    bad = ["one" + gap + " two" + gap + " three" + gap + " four" + gap + " fifth" for _ in range(40)]
    chain = toxicity.fit(clean + bad, [False] * 6_500 + [True] * 40)
    assert all(chain.odds(w) - chain.bias > 1 for w in ("one", "two", "three", "four", "fifth"))
    assert chain.score(["a", "fifth", "b"]) > chain.score(["a", "b"])


def test_toxicity_goes_by_parts_of_words():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    clean = [" ".join(word() for _ in range(12)) for _ in range(300)]
    bad = [" ".join([*(word() for _ in range(10)), "vile" + word(), "vile" + word()]) for _ in range(80)]
    chain = toxicity.fit(clean + bad, [False] * 300 + [True] * 80)
    assert chain.score(["abcdefg", "vilehgfedcb"]) > 0.5 > chain.score(["abcdefg", "hgfedcb"])


def test_chain_marginals_match_enumeration(monkeypatch):
    import itertools

    import numpy as np

    monkeypatch.setattr(toxicity, "BLOCK", 4)
    rng = np.random.default_rng(1)
    trans = rng.normal(size=(2, 2))
    lists = [rng.normal(size=n) * 2 for n in (1, 7, 3, 6)]
    starts = np.concatenate([[True] + [False] * (len(x) - 1) for x in lists])
    p, moves = toxicity.chain_marginals(np.concatenate(lists), starts, trans, moves=True)
    want, seen = [], np.zeros((2, 2))
    for odds in lists:
        weight = {t: np.exp(sum(o for o, k in zip(odds, t) if k) + sum(trans[a][b] for a, b in zip(t, t[1:]))) for t in itertools.product((0, 1), repeat=len(odds))}
        z = sum(weight.values())
        want += [sum(w for t, w in weight.items() if t[i]) / z for i in range(len(odds))]
        for t, w in weight.items():
            for a, b in zip(t, t[1:]):
                seen[a, b] += w / z
    assert np.allclose(p, want) and np.allclose(moves, seen)
    monkeypatch.setattr(toxicity, "PART", 5)
    assert np.allclose(toxicity.text_marginals(np.concatenate(lists), starts, trans)[0], want)


def test_tree_marginals_match_enumeration():
    import itertools
    import math

    model = html_text.TreeModel({"tag:p": 0.7, "tag:nav": -1.2, "bias": 0.1}, {(a, b, k): (0.9 if a == b else -0.4) for a in (0, 1) for b in (0, 1) for k in ("text", "landmark", "block")})
    nodes = html_text.order(html_text.parse("<body><nav>m</nav><article><p>one<p>two</article></body>"))
    at = {id(n): i for i, n in enumerate(nodes)}
    own = [sum(model.node.get(f, 0.0) for f in html_text.features(n)) for n in nodes]
    total, on = 0.0, [0.0] * len(nodes)
    for state in itertools.product((0, 1), repeat=len(nodes)):
        s = sum(o for o, x in zip(own, state, strict=True) if x)
        s += sum(model.edge[state[at[id(n.parent)]], state[i], html_text.kind(n)] for i, n in enumerate(nodes) if n.parent is not None)
        total += math.exp(s)
        for i, x in enumerate(state):
            on[i] += x * math.exp(s)
    assert model.marginals(nodes) == pytest.approx([v / total for v in on])


def test_pages_keep_formulas_and_fallback_texts():
    page = (
        "<body><article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><object data=a><p>fallback</p></object><canvas>drawn</canvas>"
        "<svg><path d=1 /><text>left</text><text>right</text></svg><noscript><p>plain</p></noscript><script>no()</script><button>no</button></article></body>"
    )
    nodes = html_text.order(html_text.parse(page))
    assert [n.text for n in nodes if n.tag == "text"] == ["so x=2 holds", "fallback", "drawn", "left right", "plain"]


def test_vectors_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    base, rows = rng.normal(size=(300, 24)), []
    for i in range(300):  # groups of a few, exact copies and some near ones
        rows += [(base[i] + rng.normal(size=24) * rng.choice([0, 0.15, 0.3, 0.35]), i % 3) for _ in range(rng.integers(1, 7))]
    rows += [(base[0] + rng.normal(size=24) * 0.25, 1) for _ in range(700)]  # a large group of near copies
    v = np.array([r[0] for r in rows])
    u, label = v / np.linalg.norm(v, axis=1, keepdims=True), np.array([r[1] for r in rows])
    link = (u @ u.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    root = np.arange(len(rows))
    while True:
        new = np.minimum(root, np.where(link, root[None], len(rows)).min(1))
        if (new == root).all():
            break
        root = new
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(spark.createDataFrame([(i, x.tolist(), int(k)) for i, (x, k) in enumerate(rows)], "vec_id long, embedding array<double>, label int")).collect()}
    n = np.array([got[i].n_links for i in range(len(rows))])
    assert (n <= link.sum(1)).all() and n.sum() >= 0.99 * link.sum() > 100_000
    same = np.mean([got[i].component_id == root[i] for i in range(len(rows))])
    assert same >= 0.99


def test_vectors_of_small_groups_rarely_in_the_sample(spark, monkeypatch):
    # Pairs just above the threshold; the sample of the codebooks holds both of a pair about ten times.
    import numpy as np

    monkeypatch.setattr(vector_dedup, "SAMPLE", 400)
    rng = np.random.default_rng(4)
    a = rng.normal(size=(4_000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise = rng.normal(size=a.shape)
    noise -= (noise * a).sum(1)[:, None] * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    b = 0.935 * a + (1 - 0.935**2) ** 0.5 * noise
    rows = [(2 * i + k, v[i].tolist(), 1) for k, v in enumerate((a, b)) for i in range(len(a))]
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    linked = got.where("n_links = 1").count()
    assert linked >= 0.98 * len(rows), linked / len(rows)


def test_empty_tables(spark):
    none = docs(spark, [])
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.pack_documents(none, path).count() == 0 and jaccard.similar_groups(none).count() == 0
    assert fingerprints.fingerprint_documents(none).count() == 0 and licenses.scan_licenses(none).count() == 0


