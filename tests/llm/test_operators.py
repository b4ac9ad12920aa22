"""Operators against brute force, on rows with every oddity."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from cellgrid.llm import bands, line_dedup, mixing, packing, quality, queries, simhash, substring_dedup, token_files, tokens, url_filter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


# 1 -------------------------------------------------------------------------------------------------


def brute_fingerprint(text, k):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words_of(low)
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(rows, k, radius):
    fps = [brute_fingerprint(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)].append(d)
    return [(d, fps[i], min(low[find(i)], default=None), find(i)) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("k", [3, 5])
def test_simhash_groups(odd, odd_rows, k):
    got = simhash.near_duplicate_groups(odd, shingle_words=k, radius=2).collect()
    key = lambda r: str(r)
    assert sorted(((r[0], r[1] % 2**64, r[2]) for r in got), key=key) == sorted((g[:3] for g in brute_groups([r[:2] for r in odd_rows], k, 2)), key=key)


def test_simhash_links_chains(spark):
    values = [0, 1, 3, 7, 15, 1 << 63, (1 << 63) | 3, 0xFFFF << 20, 0xFFFF << 40]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {r["fp"]: r["root"] for r in simhash.fingerprint_components(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    alike = {(i, j) for i in range(9) for j in range(9) if got[signed[i]] == got[signed[j]]}
    assert alike == {(i, j) for i in range(7) for j in range(7)} | {(7, 7), (8, 8)}


def brute_similar(rows, k=5, least=0.8):
    """Smallest id of each group of (id, text) rows linked by a Jaccard similarity of shingles; texts without words are linked."""
    sets, low = [], defaultdict(list)
    for _, t in rows:
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small >= least * large and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    for i, (d, _) in enumerate(rows):
        low[find(i)].append(d)
    return [min((d for d in ids if d is not None), default=None) for ids in low.values()]


def test_keep_one_of_each(odd, odd_rows, empty):
    kept = simhash.keep_one_of_each(odd, shingle_words=5)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(brute_similar([r[:2] for r in odd_rows]), key=str)
    assert simhash.keep_one_of_each(empty).count() == 0


def test_near_copies_go_and_clean_texts_stay(spark):
    """A text with 150 edited copies (0.86 similar to it, to one another less), pairs about 0.83, and strangers."""
    rng = random.Random(11)
    words = [f"word{i}" for i in range(3000)]

    def edited(w, places):
        w = list(w)
        for p in places:
            w[p] = rng.choice(words)
        return " ".join(w)

    base = rng.choices(words, k=400)
    rows = [(0, " ".join(base)), *((i, edited(base, rng.sample(range(0, 400, 6), 6))) for i in range(1, 151))]
    for i in range(200, 240, 2):
        w = rng.choices(words, k=rng.randrange(80, 600))
        rows += [(i, " ".join(w)), (i + 1, edited(w, [len(w) // 2 + 5 * j for j in range(len(w) // 60)]))]
    rows += [(i, " ".join(rng.choices(words, k=rng.randrange(60, 400)))) for i in range(300, 400)]
    kept = {r[0] for r in simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    assert kept == set(brute_similar(rows)) == {0, *range(200, 240, 2), *range(300, 400)}


def test_pairs_in_a_family_without_its_base(spark):
    """Texts about 0.77 like one that is not there, so less like each other, and 400 pairs of them at 0.805."""
    rng = random.Random(3)
    base = [f"base{i}" for i in range(236)]
    rows = []
    for i in range(0, 800, 2):
        at = rng.sample(range(4, 230, 5), 11)
        for own, places in ((i, at[:6]), (i + 1, at)):
            w = list(base)
            for p in places:
                w[p] = f"edit{i}x{p}"
            rows.append((own, " ".join(w)))
    kept = {r[0] for r in simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    assert kept == set(brute_similar(rows)) == set(range(0, 800, 2))


def test_small_sets_meet(spark):
    """Texts of 8 words and the same with a ninth share 4 of 5 shingles."""
    rows = []
    for i in range(0, 80, 2):
        w = [f"w{i}x{j}" for j in range(9)]
        rows += [(i, " ".join(w[:8])), (i + 1, " ".join(w))]
    met = {x for x in range(0, 80, 2) if set(bands.band_keys(hashes_of(rows[x][1]))) & set(bands.band_keys(hashes_of(rows[x + 1][1])))}
    kept = {r[0] for r in simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    assert kept == {i for i, _ in rows if i % 2 == 0 or i - 1 not in met} and len(met) >= 38


def hashes_of(text):
    return bands.unique_hashes(simhash.shingle_hashes(text.encode(), 5))


def test_bands_at_the_threshold():
    rng = np.random.default_rng(5)
    met = 0
    for _ in range(3000):
        pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        met += bool(set(bands.band_keys(np.concatenate([pool[:320], pool[320::2]]))) & set(bands.band_keys(np.concatenate([pool[:320], pool[321::2]]))))
    assert met >= 2997


def test_equal_fingerprints_do_not_make_texts_alike(spark):
    """Two texts that open with one long refrain have equal fingerprints and share a hundredth of their shingles."""
    refrain = "ha " * 200
    texts = [refrain + " ".join(f"{c}{i}" for i in range(40)) for c in "ab"]
    assert brute_fingerprint(texts[0], 5) == brute_fingerprint(texts[1], 5)
    docs = spark.createDataFrame([*enumerate(texts), (2, texts[0])], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_each(docs).collect()) == [0, 1]


def test_recall_on_documents(spark):
    """All pairs of 0.8 or more in a whole table, found here by an inverted index over every shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    assert {r[0] for r in simhash.keep_one_of_each(docs).select("doc_id").collect()} == set(brute_similar([tuple(r) for r in rows]))


def test_rows_of_one_id_and_text_leave_the_same_one(spark):
    rows = [(1, "some words that are the same here", f"x{i}") for i in range(9)]
    got = [simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, other string").repartition(n)).collect() for n in (1, 5)]
    assert got[0] == got[1] and [r["other"] for r in got[0]] == ["x0"]


# 3 -------------------------------------------------------------------------------------------------


def test_tokens_equal_the_slower_library():
    path = tokens.vocabulary()
    exact, _ = tokens._libraries(path)
    points = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070)]]
    texts = [f"{c}a{c} {c}1{c * 3}." for c in points] + ["<|endoftext|> there", "日本語 text", "it's 12,000 é\u00a0\u0085x"]
    for t in texts:
        assert tokens.token_ids(t, path).tolist() == exact.encode(t, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=60))
def test_tokens_equal_on_any_latin_text(text):
    path = tokens.vocabulary()
    assert tokens.token_ids(text, path).tolist() == tokens._libraries(path)[0].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("group", [1, 2, 1024])
def test_separator_scan(spark, tmp_path, group):
    rng = np.random.default_rng(3)
    streams = {"a": [5, 0, 70, 200, 0, 0, 3], "b": [], "c": [900], "d": [0], "e": [40, 2]}
    want = set()
    for name, lengths in streams.items():
        parts, at = [], 0
        for i, n in enumerate(lengths):
            parts += [rng.integers(1, 60000, n), [0]]
            want.add((name, i, at, n))
            at += n + 1
        flat = np.concatenate(parts) if parts else np.zeros(0)
        if name == "e":
            flat = np.append(flat, [9, 9, 9])
            want.add((name, 2, at, 3))
        flat.astype("<u2").tofile(tmp_path / name)
    blocks = token_files.read_token_files(spark, str(tmp_path), block_bytes=64)
    whole = token_files.read_token_files(spark, str(tmp_path), block_bytes=64, seek=False)
    assert Counter(map(str, blocks.collect())) == Counter(map(str, whole.collect()))
    got = token_files.count_tokens(blocks, eod=0, blocks_per_group=group).collect()
    assert {(r["file"].rpartition("/")[2], r["nth"], r["start"], r["n_tokens"]) for r in got} == want
    assert len(got) == len(want)


def test_a_truncated_token_file_is_named(spark, tmp_path):
    (tmp_path / "cut").write_bytes(b"\x01\x00\x02")
    with pytest.raises(Exception, match="cut ends within an id"):
        token_files.count_tokens(token_files.read_token_files(spark, str(tmp_path)), eod=0)


def test_document_tokens(odd, odd_rows, empty):
    path = tokens.vocabulary()
    got = token_files.document_tokens(odd)
    want = [(r[0], len(tokens.token_ids(r[1], path))) for r in odd_rows]
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got.collect()) == Counter(want)
    assert token_files.document_tokens(empty).collect() == []


def test_document_tokens_with_the_separator_inside(spark):
    texts = ["one two", f"a {tokens.END_OF_TEXT} b", "three", f"{tokens.END_OF_TEXT}{tokens.END_OF_TEXT}", "four five six seven", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["n_tokens"] for r in token_files.document_tokens(docs).collect()}
    assert got == {i: len(tokens.token_ids(t, tokens.vocabulary())) for i, t in enumerate(texts)}


def test_ids_beyond_16_bits_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(token_files, "IN_TEXT", 50)
    with pytest.raises(Exception, match="16 bits"):
        token_files.tokenize_to_blocks(spark.createDataFrame([(1, "some words")], "doc_id long, text string")).collect()


@pytest.mark.parametrize("run", [" ", "\n", "\t ", "a", "7", "!?", "\u00a0"])
def test_very_long_runs(spark, tmp_path, run):
    """A run of one class of characters exhausts neither library: the queries give the slower library's ids."""
    long = f"before {run * (1_500_000 // len(run))} after"
    ids = tokens._libraries(tokens.vocabulary())[0].encode(long, add_special_tokens=False).ids
    spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op3_token_counts(spark, str(tmp_path)).collect()}
    assert got[1] == len(ids)
    pieces = sorted((r["start"], r["length"], r["ids_crc32"]) for r in queries.op9_best_fit_packing(spark, str(tmp_path)).where("doc_id = 1").collect())
    whole = np.array([*ids, 2], "<u4")
    assert pieces == [(a, n, zlib.crc32(whole[a : a + n].tobytes())) for a, n in packing.cut_points(len(whole), 1024)]


def test_tokens_in_small_blocks(odd, odd_rows):
    blocks = token_files.tokenize_to_blocks(odd, block_bytes=128).cache()
    got = token_files.count_tokens(blocks, blocks_per_group=3)
    path = tokens.vocabulary()
    assert sorted(r["n_tokens"] for r in got.collect()) == sorted(len(tokens.token_ids(r[1], path)) for r in odd_rows)
    assert Counter(i for r in blocks.collect() for i in r["ids"]) == Counter(r[0] for r in odd_rows)


# 4 -------------------------------------------------------------------------------------------------


def brute_repeats(texts, window):
    count = Counter()
    for t in texts:
        w = words_of(t)
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    for t in texts:
        w = words_of(t)
        gone = {p for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        yield len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("window", [3, 10, 35])
def test_substring_dedup(odd, odd_rows, empty, window):
    got = substring_dedup.remove_repeats(odd, window=window)
    want = Counter((r[0], *b) for r, b in zip(odd_rows, brute_repeats([r[1] for r in odd_rows], window), strict=True))
    rows = got.select("row.doc_id", "n_words", "n_removed", "kept_text", "spans").collect()
    assert Counter(tuple(r)[:4] for r in rows) == want
    assert all(sum(b - a for a, b in r["spans"]) == r["n_removed"] for r in rows)
    assert substring_dedup.remove_repeats(empty, window=window).collect() == []


# 5 -------------------------------------------------------------------------------------------------


def brute_quality(text):
    text = text or ""
    w = words_of(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    held = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in range(i, i + 3)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(w) < 50 or 100 * len(held) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(held), failed


def test_quality(odd, odd_rows, empty):
    got = quality.scores(odd).collect()
    shown = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got)
    assert shown == Counter((r[0], *brute_quality(r[1])) for r in odd_rows)
    assert all(not (r["kept"] and r["base_failed"]) for r in got)
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.scores(empty).collect() == [] and quality.keep_good(empty).collect() == []


def test_quality_bands(spark):
    rng = np.random.default_rng(1)
    prose = " ".join("".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(3000))
    noise = "".join(chr(c) for c in rng.integers(33, 127, 20_000))
    noise = " ".join(noise[i : i + 6] for i in range(0, len(noise), 6))
    numbered = " ".join(f"the very same sentence again and again {i}" for i in range(900))
    texts = {"prose": prose, "noise": noise, "numbered": numbered, "half": prose + " " + noise, "short": " ".join(prose.split()[:60]), "tabs # %\n" * 60: "a b"}
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id long, text string")
    assert [r["kept"] for r in quality.scores(frame).orderBy("doc_id").collect()] == [True, False, False, False, True, False]


def brute_kept(texts):
    """The verdict from zstandard ratios and numpy quantiles of rows, not of counted hundredths."""
    packer = zstandard.ZstdCompressor(level=3, write_content_size=False)
    ratio = lambda b: (len(b), len(packer.compress(b)))
    data = [(t or "").encode() for t in texts]
    failed = [brute_quality(t)[5] for t in texts]
    cut = [[d] if len(d) <= 4096 else [c for i in range(0, len(d), 4096) if len(c := d[i : i + 4096]) >= 1024] for d in data]
    whole, parts = [ratio(d) for d in data], [[ratio(c) for c in cs] for cs in cut]
    bands = []
    first = {d: i for i, d in reversed(list(enumerate(data)))}.values()  # each text once, all of its chunks
    for sizes in ([whole[i] for i in first if not failed[i]], [c for i in first if not failed[i] for c in parts[i]]):
        bins = defaultdict(list)
        for n, m in sizes:
            bins[math.floor(2 * math.log2(n))].append(math.floor(100 * n / m) / 100 + 0.005)
        made = {}
        for b in bins:
            found = []
            for far in range(200):
                found += [x for other in {b - far, b + far} for x in bins.get(other, [])]
                if far >= 1 and len(found) >= 50:
                    break
            low, high = max(x for x in quality.LIMITS if x[0] <= 2 ** (b / 2))[1:]
            found += [low + (high - low) * (i + 0.5) / 4 for i in range(4)]
            q1, q2, q3 = (np.quantile(found, q, method="inverted_cdf") for q in (0.25, 0.5, 0.75))
            reach = max(2 * (q3 - q1), q2 * (0.06 + 2 / math.sqrt(2 ** (b / 2))))
            made[b] = max(low, q1 - reach), min(high, q3 + reach)
        bands.append(made)
    inside = lambda x, made: made[math.floor(2 * math.log2(x[0]))][0] <= x[0] / x[1] <= made[math.floor(2 * math.log2(x[0]))][1]
    return [not f and inside(w, bands[0]) and sum(not inside(c, bands[1]) for c in cs) <= 0.25 * len(cs) for f, w, cs in zip(failed, whole, parts, strict=True)]


def test_quality_query_on_documents(spark):
    """The whole query, and that its bands reject marked-up junk and leave documents labelled good alone."""
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    good = {r[0] for r in spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").select("doc_id").collect()}
    want = {r[0]: (*brute_quality(r[1]), k) for r, k in zip(rows, brute_kept([r[1] for r in rows]), strict=True)}
    got = {r["doc_id"]: r for r in queries.op5_quality_rules(spark, folder).collect()}
    assert {d: tuple(r)[1:] for d, r in got.items()} == want
    banned = {d for d, r in got.items() if not r["base_failed"] and not r["kept"]}
    assert len(banned) >= 10 and len(banned & good) <= 0.005 * len(good)


def test_bands_do_not_depend_on_the_size_of_the_corpus(spark):
    """Texts taken twenty times, with a word more each, give the bands that the texts alone give."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    more = docs.crossJoin(spark.range(20)).select(F.concat_ws(" ", "text", F.concat(F.lit("w"), "id")).alias("text"))
    measured = lambda d: d.select(quality._key(F.col("text")), quality.measure(F.col("text")).alias("m")).select("key", "m.*")
    one, many = quality.fit_bands(measured(docs)), quality.fit_bands(measured(more))
    shared = [(one[k][b], many[k][b]) for k in one for b in one[k] if b in many[k] and 16 <= b]
    assert len(shared) > 15
    far = [max(abs(x - y) for x, y in zip(a, b, strict=True)) for a, b in shared]
    assert sorted(far)[len(far) // 2] < 0.1 and max(far) < 0.5, list(zip(far, shared, strict=True))
    copies = quality.fit_bands(measured(docs.crossJoin(spark.range(20)).select("text")))
    assert copies == one


def test_lengths_take_in_their_neighbours():
    bins = {10: {200: 30}, 11: {210: 8}, 13: {220: 15}, 20: {300: 5}}
    assert quality.with_neighbours(bins, 10) == {200: 30, 210: 8, 220: 15}
    assert quality.with_neighbours(bins, 20) == {300: 5, 220: 15, 210: 8, 200: 30}
    assert quality.with_neighbours({10: {200: 250}, 11: {210: 30}, 12: {200: 9}}, 10) == {200: 250, 210: 30}
    assert quality.with_neighbours({}, 3) == {}


# 6 -------------------------------------------------------------------------------------------------

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/e"), ("block", "bad.org", ""), ("allow", "com", "/"), ("block", "", "")]


def brute_url(url, rules):
    head, sep, rest = (url or "").partition("://")
    host = re.match(r"[^/?#]*", rest)[0] if sep else ""
    path = re.match(r"[^?#]*", rest[len(host) :])[0] if sep else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[1] if best else "allow"


def test_urls(spark):
    urls = [None, "", "no scheme/en/", "http://", "http://a.com", "http://a.com/", "https://Example.COM/en/x?q", "http://x.www.example.com/en/", "http://www.example.com/en", "http://b.net/every", "http://b.net/?/e", "http://bad.org", "http://bad.org#f", "http://notbad.org/", "http://a..com/", "http://com./", "a://b://c.com/", "http://é.com/en/", "http://bad.org\n/x", "http://a.com:80/", "http://a.com/" + "p/" * 3000]
    rows = [(i if i % 5 else None, u, "host", 1) for i, u in enumerate(urls)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path int")
    for rules in (RULES, RULES[:5], []):
        got = url_filter.judge_urls(pages, url_filter.rule_table(spark, rules))
        assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
        assert Counter(map(tuple, got.collect())) == Counter((i, *brute_url(u, rules)) for i, u, *_ in rows)
    assert url_filter.judge_urls(pages.where("false"), url_filter.rule_table(spark, RULES)).collect() == []


def test_a_host_of_many_labels(spark):
    """Suffixes are as many as the rules' hosts have different numbers of labels, not as the URL's host has."""
    url = "http://" + "a." * 100_000 + "www.example.com/en/x"
    got = url_filter.judge_urls(spark.createDataFrame([(1, url)], "page_id long, url string"), url_filter.rule_table(spark, RULES[:5])).collect()
    assert [(r["rule"], r["verdict"]) for r in got] == [("www.example.com/en/", "allow")]


# 7 -------------------------------------------------------------------------------------------------


def test_line_dedup(odd, odd_rows, empty):
    pages, held = Counter(), Counter()
    for r in odd_rows:
        pages[r[3]] += 1
        held.update((r[3], x) for x in set((r[1] or "").split("\n")) if WORD.search(x))
    want = Counter()
    for r in odd_rows:
        lines = (r[1] or "").split("\n")
        keep = [x for x in lines if not (held[r[3], x] >= 2 and held[r[3], x] > 0.12 * pages[r[3]])]
        want[r[0], len(lines), len(lines) - len(keep), "\n".join(keep)] += 1
    got = line_dedup.drop_boilerplate(odd, ratio=0.12, min_pages=2).select("row.doc_id", "n_lines", "n_dropped", "kept_text")
    assert Counter(map(tuple, got.collect())) == want and any(k[2] for k in want)
    assert line_dedup.drop_boilerplate(empty).collect() == []


def test_line_dedup_by_host(spark):
    """Pages grouped by their URL's host, as the odd rows are by source."""
    rows = [(i, f"HTTP://{'ab'[i % 2]}.org/{i}" if i % 9 else None, f"menu {i % 2 if i % 9 else 'x'}\nline {i}\nfoot") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = line_dedup.drop_boilerplate(pages, text_col="html", site=url_filter.url_host(pages["url"]))
    assert {r["row"]["page_id"]: r["kept_text"] for r in got.collect()} == {i: f"line {i}" for i, _, _ in rows}


# 8 -------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while rest := [s for s in names if s not in full]:
        rate = (total - sum(full.values())) / sum(w[s] for s in rest)
        new = {s: most * sizes[s] for s in rest if w[s] * rate >= most * sizes[s]}
        if not new:
            return full | {s: w[s] * rate for s in rest}
        full |= new
    return full


def test_mixture(odd, odd_rows, empty):
    sizes, largest = Counter(), Counter()
    for r in odd_rows:
        n = len(words_of(r[1]))
        sizes[r[3]] += n
        largest[r[3]] = max(largest[r[3]], n * 3)  # rows repeated as a whole go together
    want = brute_targets(sizes)
    got = mixing.mixture(odd).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(words_of(r[1]))) for r in odd_rows)
    taken, seen = Counter(), {}
    for r in got:
        assert r["times"] in (0, 1, 2)
        seen[r["source_size"]] = r["target"]
        taken[r["source_size"]] += r["size"] * r["times"]
    assert len(seen) == len(sizes)
    for s, n in sizes.items():
        assert seen[n] == pytest.approx(want[s]) and abs(taken[n] - want[s]) <= largest[s]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixture(odd.repartition(5)).collect()))
    rows = mixing.take_mix(odd)
    assert rows.columns == odd.columns and rows.count() == sum(r["times"] for r in got)
    assert mixing.mixture(empty).collect() == [] and mixing.take_mix(empty).collect() == []


def test_mixture_comes_near(spark):
    rows = [(i, "w " * (1 + i * 7919 % 300), f"s{min(i % 11, 4)}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(docs).groupBy("source_size", "target").agg({"*": "count"}).collect()
    sums = {r["source_size"]: r["t"] for r in mixing.mixture(docs).selectExpr("source_size", "size * times as t").groupBy("source_size").agg({"t": "sum"}).withColumnRenamed("sum(t)", "t").collect()}
    assert all(abs(sums[r["source_size"]] - r["target"]) <= 300 for r in got)


# 9 -------------------------------------------------------------------------------------------------


def test_packing(odd, odd_rows, empty):
    path = tokens.vocabulary()
    packed = packing.pack(odd, with_ids=True).collect()
    whole = Counter((r[0], tuple(tokens.token_ids(r[1], path).tolist()) + (2,)) for r in odd_rows)
    want = Counter()
    for (doc, ids), n in whole.items():
        for i, (a, m) in enumerate(packing.cut_points(len(ids), 1024)):
            want[doc, i, a, m, zlib.crc32(np.array(ids[a : a + m], "<u4").tobytes()), ids[a : a + m]] += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in packed) == want
    bins = defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 1024
    decreasing: list[int] = []
    for n in sorted((r["length"] for r in packed), reverse=True):
        i = next((i for i, held in enumerate(decreasing) if held + n <= 1024), len(decreasing))
        decreasing[i : i + 1] = [n + (decreasing[i] if i < len(decreasing) else 0)]
    assert len(bins) <= len(decreasing)
    assert packing.pack(empty).collect() == []


def test_sequences(odd):
    packed = packing.pack(odd.where("length(text) < 400"), with_ids=True).cache()
    got = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert got[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1, max_size=12))
def test_fullest_bin_is_the_fullest(counts):
    used = packing.fullest(counts, 60)
    assert used[0] == max(counts) and all(n <= counts[x] for x, n in Counter(used).items())
    sums = {used[0]}
    for x, n in counts.items():
        sums = {s + i * x for s in sums for i in range(n - (x == used[0]) + 1) if s + i * x <= 60}
    assert sum(used) == max(sums)


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 5000), min_size=1, max_size=30))
def test_plan_covers_every_piece_once(counts):
    plan = packing.plan_bins(counts, 64)
    for x, n in counts.items():
        at = 0
        for r in plan[plan["length"] == x].itertuples():
            assert r.rank == at
            at = r.until
        assert at == n
    bins = {r.sequence: (r.until - r.rank) // r.uses for r in plan.itertuples()}
    least = -(-sum(x * n for x, n in counts.items()) // 64)
    assert sum(bins.values()) >= least


# 10 ------------------------------------------------------------------------------------------------


def brute_warc(rows, least):
    newest = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= least:
            newest[h or ""] = max([x for x in (i, newest.get(h or "")) if x is not None], default=None)
    for i, _, h in rows:
        data = (h or "").encode()
        to = newest.get(h or "")
        to = None if to == i else to
        yield i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to


@pytest.mark.parametrize(("least", "frame"), [(0, 200), (5, 1 << 20), (0, 1)])
def test_warc(spark, tmp_path, least, frame):
    pages = [None, "", "<p>é</p>", "same", "same", "same", "long " * 4000, "a\r\n\r\nb", "Content-Length: 9", None]
    urls = [None, "http://é.com/ x", "http://a.com/\r\nX: y", *[f"http://b/{i}" for i in range(7)]]
    rows = [(i if i != 6 else None, u, h) for i, (u, h) in enumerate(zip(urls, pages, strict=True))] + [(5, "http://twice", "same"), (None, "http://n", "same")]
    rows += [(2**60 + 1, "http://x", "far"), (2**60 + 2, "http://y", "other"), (2**60 + 3, "http://z", "far")]
    frame_of = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    bundles = warc.write_bundles(frame_of, min_bytes=least, frame_bytes=frame, bundle_bytes=300).cache()
    got = warc.read_bundles(bundles, with_payload=True).collect()
    assert Counter((r[0], r[2], r[3], r[4], r[5]) for r in got) == Counter(brute_warc(rows, least))
    assert all(bytes(r["payload"]).decode() in {r[2] or "" for r in rows} for r in got if r["record_type"] == "response")
    one = warc.read_bundles(warc.find_record(bundles, 4)).collect()
    assert [r["page_id"] for r in one] == [4]
    import zstandard

    for name in warc.export(bundles, str(tmp_path)):
        with open(name, "rb") as f:
            plain = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        assert plain.startswith(b"WARC/1.1\r\n") and plain.endswith(b"\r\n\r\n")
    assert warc.write_bundles(frame_of.where("false")).collect() == []
