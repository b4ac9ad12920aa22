"""The pipeline's stages, each against brute force on its own input."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from cellgrid.llm import line_dedup, packing, tokens
from tests.llm.test_operators import WORD, brute_kept, brute_similar, brute_targets, words_of


@pytest.fixture(scope="module")
def stages(spark, odd):
    """(name, input rows, output rows) of each stage over the small table with the odd rows beside it."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(odd.drop("v", "row"))
    out = []
    for name, f in corpus_pipeline.STAGES:
        after = f(spark, docs, "/root/testdata/sf0.001").cache()
        out.append((name, docs, after))
        docs = after
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_columns_and_names(stages):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [s[0] for s in stages] == [n for n, _ in corpus_pipeline.STAGES]
    assert all(s[2].columns == columns for s in stages[:-1])


def test_quality_stage(stages):
    _, docs, after = stages[0]
    before = rows(docs)
    assert Counter(rows(after)) == Counter(r for r, k in zip(before, brute_kept([r[1] for r in before]), strict=True) if k)


def test_line_stage(stages):
    _, docs, after = stages[1]
    pages, held = Counter(), Counter()
    for r in rows(docs):
        pages[r[3]] += 1
        held.update((r[3], x) for x in set(r[1].split("\n")) if WORD.search(x))
    want = Counter()
    for r in rows(docs):
        text = "\n".join(x for x in r[1].split("\n") if not (held[r[3], x] >= line_dedup.MIN_PAGES and held[r[3], x] > line_dedup.RATIO * pages[r[3]]))
        want[r[0], text, r[2], r[3], r[4] if text == r[1] else len(text)] += 1
    assert Counter(rows(after)) == want


def test_near_dedup_stage(stages):
    _, docs, after = stages[2]
    before = rows(docs)
    assert Counter(r[0] for r in rows(after)) == Counter(brute_similar([r[:2] for r in before]))
    assert not Counter(rows(after)) - Counter(before)


def test_mix_stage(stages):
    _, docs, after = stages[3]
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in rows(docs):
        n = len(words_of(r[1]))
        sizes[r[3]] += n
        longest[r[3]] = max(longest[r[3]], n)
    times = Counter(rows(after))
    for r, n in times.items():
        taken[r[3]] += n * len(words_of(r[1]))
    assert max(times.values()) <= 2 and set(times) <= set(rows(docs))
    for s, goal in brute_targets(sizes).items():
        assert abs(taken[s] - goal) <= longest[s]


def test_packing_stage(stages):
    _, docs, after = stages[4]
    path = tokens.vocabulary()
    want, bins = Counter(), defaultdict(list)
    for r in rows(docs):
        for i, (a, n) in enumerate(packing.cut_points(len(tokens.token_ids(r[1], path)) + 1, 1024)):
            want[r[0], i, a, n] += 1
    got = rows(after)
    assert Counter(r[:4] for r in got) == want
    for r in got:
        bins[r[5]].append((r[6], r[3]))
    for held in bins.values():
        ends = [0]
        for at, n in sorted(held):
            assert at == ends[-1]
            ends.append(at + n)
        assert ends[-1] <= 1024


def test_run_is_the_stages(spark, tmp_path, stages):
    stages[0][1].write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(tuple(r)[:5] for r in got.collect()) == Counter(r[:5] for r in rows(stages[-1][2]))
