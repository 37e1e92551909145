"""Work that grew faster than the input, or was shuffled without need."""

import random

import numpy as np

from pyspark.sql import functions as F

from riskframe.functions import predicates, text
from riskframe.ml import neighbours
from riskframe.operators import similarity
from riskframe.prep import select


def test_sketches_keep_every_similar_pair(spark):
    """Dissimilar candidates fetch no word sets, and no pair that reaches the share is lost."""
    rng, rows = random.Random(5), []
    for i in range(60):
        n = rng.choice([3, 40, 400, 2500])
        own = [f"w{rng.randrange(6000)}" for _ in range(n)]
        rows += [(f"{i:03}a", " ".join(own)), (f"{i:03}b", " ".join(own[: n - n // 9] + [f"v{i}"]))]
    sets = similarity._word_sets(similarity.signatures(spark.createDataFrame(rows, "k string, t string"), "k", "t"))
    met = sets.select(F.col("sid").alias("a")).join(sets.select(F.col("sid").alias("b")), F.col("a") > F.col("b"))
    held = {r["sid"]: set(r["tokens"]) for r in sets.collect()}
    likely = {(r["a"], r["b"]) for r in similarity._likely(met, similarity._sketches(sets), 0.75).collect()}
    similar = {(a, b) for a in held for b in held if a > b and len(held[a] & held[b]) / len(held[a] | held[b]) >= 0.75}
    assert len(similar) >= 40 and similar <= likely
    assert len(likely - similar) < 0.2 * len(held) * (len(held) - 1) / 2


def test_lemmatize_shuffles_texts_not_words(spark):
    docs = spark.createDataFrame([(1, "a  b c a"), (2, None), (3, ""), (4, "c")], "k long, t string")
    lemmas = spark.createDataFrame([("a", "L1"), ("a", "L0"), ("c", "L2")], "w string, l string")
    out = text.lemmatize(docs, "k", "t", lemmas, "w", "l")
    assert dict(out.collect()) == {1: "L0 b L2 L0", 2: None, 3: "", 4: "L2"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    words = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "_s" in line]
    assert not words, words


def test_keyword_windows_equal_every_window(spark):
    """All windows measured by hand, pieces that overlap themselves and both ends included."""
    rng, keyword, edits = random.Random(8), "aaabaaab", 1
    texts = ["".join(rng.choice("aaab cé\U0001f600") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    for _ in range(100):
        near = list(keyword)
        near[rng.randrange(8)] = rng.choice(["", "c", "aa", "é"])
        texts.append("".join(rng.choice("aab c") for _ in range(rng.randint(0, 4))) + "".join(near) + rng.choice(["", "a", " b😀"]))
    texts += ["aaabaaa", "aabaaab", "aabaaab c", "c aaabaaa", "aaab\0aab", "x" * 300 + "aaabxaab"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, old = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(row[-1] + 1, old[j + 1] + 1, old[j] + (x != y)))
        return row[-1]

    m = len(keyword)
    want = [any(distance(t[i : i + m], keyword) <= edits for i in range(max(1, len(t) - m + 1))) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    column = text._window_match(F.col("t"), keyword, edits)
    got = [r[1] for r in sorted(df.select("i", column).collect())]
    assert got == want and 20 < sum(want) < 380
    # One window is not a step of a loop over all places of a chunk any more.
    assert "sequence" not in df.select(column)._jdf.queryExecution().analyzed().toString()


def test_script_reads_no_more_than_the_first_other_character(spark):
    rows = [("abc DЖ", "CYRILLIC"), ("KΣ", "GREEK"), ("İ", "COMBINING"), ("abc", "LATIN"), ("", "LATIN"), (None, "LATIN"), ("a\nЖ", "LATIN"), ("a É", "LATIN"), ("\U0001f600", "GRINNING")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    out = df.select("i", text.script("t").alias("s"))
    assert [r["s"] for r in out.orderBy("i").collect()] == [w for _, w in rows]
    assert "regexp_replace(lower(t" not in out._jdf.queryExecution().analyzed().toString()


def test_joint_counts_hold_small_blocks():
    """A Python process of an executor holds one block: about 8 MB for each of its arrays."""
    assert select.joint_counts.__defaults__ == (select.BLOCK_VALUES,) and select.BLOCK_VALUES <= 1_000_000


def test_neighbours_are_searched_in_blocks_not_by_query(spark, monkeypatch):
    """Where distances hardly differ every block is reached; rows are then sent once for a pair of blocks, not for a query and a block."""
    rng, sent = np.random.default_rng(3), []
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(3000, 24)))]
    kept = neighbours.durable
    monkeypatch.setattr(neighbours, "durable", lambda df: sent.append(kept(df)) or sent[-1])
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found = neighbours.nearest(df, df, "id", "v", 3).collect()
    held = np.array([v for _, v in rows])
    apart = ((held[:, None] - held[None]) ** 2).sum(2)
    np.fill_diagonal(apart, np.inf)
    want = {(i, int(j)) for i in range(len(rows)) for j in np.argsort(apart[i])[:3]}
    assert {(r["id"], r["neighbour"]) for r in found} == want
    assert max(t.count() for t in sent) <= 8 * len(rows)


def test_titles_too_short_to_win_are_not_written(spark, monkeypatch):
    rng, sent = random.Random(2), []
    made = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(40)]
    titles = [" ".join(rng.choices(made, k=rng.choice([3, 5, 5, 40]))) for _ in range(600)] + [None, "", "rare", made[0] + " " + "z" * 200]
    terms = [" ".join(rng.choices(made, k=3)) for _ in range(30)] + ["rare", "none such", made[1]]

    def score(title, term):
        return len(set(title) & set(term)) / len(set(title) | set(term)) * len(title)

    want = {}
    for term in terms:
        for title in filter(None, titles):
            if set(title.split()) & set(term.split()) and score(title, term) > 2.0:
                want[term] = min(want.get(term, (0, "")), (-score(title, term), title))
    kept = similarity.durable
    monkeypatch.setattr(similarity, "durable", lambda df: sent.append(kept(df)) or sent[-1])
    frames = [spark.createDataFrame([(x,) for x in rows], f"{name} string") for rows, name in ((terms, "term"), (titles, "title"))]
    got = similarity.best_titles(frames[0], "term", frames[1], "title", 2.0).collect()
    assert {r["term"]: (round(-r["score"], 2), r["title"]) for r in got} == {k: (round(s, 2), t) for k, (s, t) in want.items()}
    written = {r["title"] for t in sent if "title" in t.columns for r in t.select("title").collect()}
    assert len(written) < 250 and not [t for t in written if len(t) < 20 and t != "rare"]


def test_far_words_are_not_looked_up_by_their_pieces(spark, monkeypatch):
    """Pieces of one or two letters meet nearly every entry, many times; far words are compared with each entry once."""
    rng, calls = random.Random(4), []
    entries = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["", None, "aa\U0001f600b"]
    words = ["".join(rng.choice("abcdefgü\U0001f600") for _ in range(rng.randint(1, 14))) for _ in range(200)] + ["", None, "aaaaaaaaaaaa", "a"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, old = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(row[-1] + 1, old[j + 1] + 1, old[j] + (x != y)))
        return row[-1]

    within = similarity._closest_within
    monkeypatch.setattr(similarity, "_closest_within", lambda *a: calls.append(a[-1]) or within(*a))
    frames = [spark.createDataFrame([(x,) for x in rows], f"{name} string") for rows, name in ((words, "w"), (entries, "e"))]
    got = {r["w"]: (r["distance"], r["closest"]) for r in similarity.closest_words(frames[0], "w", frames[1], "e").collect()}
    assert got == {w: min((distance(w, e), e) for e in filter(None, entries)) for w in filter(None, words)}
    assert calls == [2] and max(d for d, _ in got.values()) > 4


def test_terms_are_looked_up_by_words_of_all_texts(spark):
    """Texts themselves are read for their words and for the terms these fetch, and no text is spread out by its characters."""
    rng = random.Random(6)

    def made(n):
        return "".join(rng.choice("aabBcé  .-\n\x01\u0085ñ") for _ in range(n))

    texts = [made(rng.randint(0, 60)) for _ in range(150)] + [None, "", "One  two, three", "x" * 3000 + "needle-y"]
    for terms in ([made(rng.randint(3, 9)) for _ in range(40)], ["NE two, thr", "needle", " ", "", None], ["--", ". .", "-\u0085", "c"], ["b.a", "zz"], []):
        low = [t.lower() for t in terms if t and t.strip(" ")]
        want = {i for i, x in enumerate(texts) if x is not None and any(t in x.lower() for t in low)}
        df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
        out = predicates.with_any_term(df, "i", "x", spark.createDataFrame([(t,) for t in terms], "t string"), "t")
        assert {r["i"] for r in out.collect()} == want, terms
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("LogicalRDD") == 2 and "split(_x" in plan and ", , -1)" not in plan


def test_ngrams_split_a_text_once(spark):
    rows = ["a b  a b", "", None, " c ", "é a\tb a", "a"]
    want = {}
    for row in filter(None, rows):
        held = row.split()
        for n in (1, 2, 3):
            for i in range(len(held) - n + 1):
                gram = " ".join(held[i : i + n])
                want[gram] = want.get(gram, 0) + 1
    out = text.ngram_frequencies(spark.createDataFrame([(r,) for r in rows], "t string"), "t", 3)
    assert dict(out.collect()) == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert out.count() == len(want) and text.ngram_frequencies(spark.createDataFrame([("b b a",)], "t string"), "t", 1).count() == 2


def _texts(rng, groups, copies):
    """Groups of like texts that share frequent words with all others."""
    rows = []
    for g in range(groups):
        own = [f"g{g}w{i}" for i in range(30)] + [f"all{i}" for i in range(30)]
        for c in range(copies):
            kept = [w for w in own if rng.random() > 0.06] + [f"x{g}y{c}z{i}" for i in range(rng.randrange(3))]
            rows.append((f"{g:02}{c:03}", " ".join(kept)))
    return rows


def test_dissimilar_sets_hardly_become_candidates(spark):
    """Sets that share a rare word by chance are told apart before any of their words are fetched."""
    rng = random.Random(8)
    rows = _texts(rng, 12, 8) + [(f"z{i:03}", " ".join(f"c{rng.randrange(400)}" for _ in range(rng.choice([3, 20, 60])))) for i in range(150)]
    sets = similarity._word_sets(similarity.signatures(spark.createDataFrame(rows, "k string, t string"), "k", "t"))
    held = {r["sid"]: set(r["tokens"]) for r in sets.collect()}
    similar = {(a, b) for a in held for b in held if a > b and len(held[a] & held[b]) / len(held[a] | held[b]) >= 0.75}
    index = similarity._prefix_index(sets, 0.75)
    met = [(r["a"], r["b"]) for r in similarity._candidates(index, index, 0.75, True).collect()]
    assert len(similar) > 150 and similar <= set(met) and len(met) == len(set(met)) < 2 * len(similar)
    other = sets.where("sid >= '06'").select("*")
    crossed = similarity._candidates(similarity._prefix_index(other, 0.75), index, 0.75, False).collect()
    both = similar | {(b, a) for a, b in similar}
    assert {p for p in both if p[0] >= "06"} <= {(r["a"], r["b"]) for r in crossed} and len(crossed) == len(set(crossed))


def test_words_are_told_apart_where_numbers_are_the_same(spark, monkeypatch):
    number = similarity._number
    monkeypatch.setattr(similarity, "_number", lambda w, seed: number(w, seed) if seed else F.pmod(number(w, seed), F.lit(5)))
    sets = similarity._word_sets(similarity.signatures(spark.createDataFrame([("1", "a b c d e f g h a"), ("2", "")], "k string, t string"), "k", "t"))
    assert [(r["sid"], r["word_count"], len(set(r["tokens"]))) for r in sets.collect()] == [("1", 9, 8)]


def test_words_are_cut_as_cleaning_and_splitting_did(spark):
    texts = ["A-b  c\t\u212a \u0130x\u00e9Y\n9.9", "", None, " \u3000 ", "ABC abc Abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    want = similarity.words(F.lower(similarity.clean_name(F.coalesce("t", F.lit("")))))
    want = df.select(F.col("k").cast("string"), F.sort_array(F.array_distinct(want)), F.size(want)).collect()
    got = similarity._worded(df, "k", "t", True).select("_key", "tokens", "word_count").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_closest_groups_of_one_component_take_no_rounds(spark, monkeypatch):
    """A hundred like texts claim one another one after another; the number of tables written stays that of a few."""
    rng, written, real = random.Random(9), [], similarity.durable
    monkeypatch.setattr(similarity, "durable", lambda df: written.append(1) or real(df))

    def chosen(rows):
        written.clear()
        df = spark.createDataFrame(rows, "k string, t string")
        got = {r["k"]: r["similar_key"] for r in similarity.similar_groups(df, "k", "t", 0.75, only_max=True).collect()}
        found, claimed, want = {k: set(t.split()) for k, t in rows}, set(), {k: None for k, _ in rows}
        counts = {k: len(t.split()) for k, t in rows}
        for a in sorted(found, reverse=True):
            near = {} if a in claimed else {b: len(found[a] & found[b]) / len(found[a] | found[b]) for b in found if b != a and b not in claimed}
            near = {b: s for b, s in near.items() if s >= 0.75 - 1e-12 and counts[b] >= np.ceil(round(counts[a] * 0.75, 9))}
            if near:
                best = [b for b, s in near.items() if s >= max(near.values()) - 1e-12]
                claimed.update([a, *best])
                want.update({k: a for k in [a, *best]})
        assert got == want
        return len(written)

    few = chosen(_texts(rng, 1, 6))
    assert chosen(_texts(rng, 2, 60)) <= few + 12


def test_components_of_chains_and_cliques(spark):
    """Chains of 300 in order, a clique and single edges: one root each, in logarithmically many rounds."""
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(299)] + [(f"q{i}", f"q{j}") for i in range(6) for j in range(i)] + [("x", "y")]
    got = similarity._components(spark.createDataFrame(edges, "a string, b string")).collect()
    parts = {}
    for r in got:
        parts.setdefault(r["root"], set()).add(r["sid"])
    assert sorted(map(len, parts.values())) == [2, 6, 300] and len(got) == 308
