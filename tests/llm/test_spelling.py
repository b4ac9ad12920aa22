"""Spelling variants against all pairs."""

import random
import zlib
from collections import Counter
from itertools import combinations

import pytest

from cellgrid.llm import queries, spelling

SF = "/root/testdata/sf0.001"
CAPITALS = {c: chr(c + 32) for c in range(65, 91)}


def brute_counts(docs):
    seen = Counter()
    for doc, text in docs:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                word = run.translate(CAPITALS)
                h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
                seen[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 199 == 0 else word] += 1
            run = ""
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(n):
    near = {w: [] for w in n}
    for a, b in combinations(sorted(n), 2):
        if abs(len(a) - len(b)) < 2 and one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return Counter((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def rows(df):
    return Counter(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    counts = brute_counts(docs)
    assert len(counts) > 500
    assert rows(queries.op12_spelling_variants(spark, SF)) == brute_groups(counts)


def test_query_on_odd_texts(spark, odd_rows, tmp_path):
    rng = random.Random(5)
    bases = ["".join(rng.choices("abcdéÿß", k=rng.randrange(6, 14))) for _ in range(12)]
    texts = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = rng.choice(bases)
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + "b" + w[at:], w[:at] + "c" + w[at + 1 :]])
            words.append(rng.choice([w, w.translate({v: k for k, v in CAPITALS.items()})]))
        texts.append(rng.choice(["-", " ", "\n", "1"]).join(words))
    docs = [(2**60 + i if i % 3 else None, t, "en", "s", 0, "v", 1) for i, t in enumerate(texts)] + list(odd_rows)
    docs += [(1, "x" * 200_000 + " " + "abcdefg " * 5, "en", "s", 1, "v", 1)] * 6
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, word string, n int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    counts = brute_counts([d[:2] for d in docs])
    assert "x" * 200_000 in counts and any(len(w) < 10 for w in counts)
    assert rows(queries.op12_spelling_variants(spark, str(tmp_path))) == brute_groups(counts)


@pytest.mark.parametrize("letters", ["ab", "abcde"])
def test_every_near_pair_meets(letters):
    rng = random.Random(9)
    words = {"".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(300)}
    order = {a + b: i for i, (a, b) in enumerate(rng.sample([(a, b) for a in letters for b in letters], len(letters) ** 2))}
    keys = {w: tuple(map(set, spelling.meeting_keys(w, order))) for w in words if len(w) >= 4}
    for a, b in combinations(sorted(keys), 2):
        if one_edit(a, b):
            long, short = sorted((a, b), key=len, reverse=True)
            assert keys[long][0] & keys[short][len(a) != len(b)], (a, b)


def test_chains_ties_and_no_words(spark):
    n = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "bbbbbb": 5, "bbbbba": 25, "bbbbbc": 25, "zzzzzz": 7}
    got = spelling.variant_groups(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert rows(got) == brute_groups(n)
    assert {r["root"] for r in got.collect() if r["word"].startswith("aaaa")} == {"aaabbb"}
    assert spelling.variant_groups(spark.createDataFrame([], "word string, n long")).count() == 0
