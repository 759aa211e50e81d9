"""Each operator against brute force on a small fixture with odd rows, and on an empty table."""

from __future__ import annotations

import base64
import collections
import hashlib
import ipaddress
import itertools
import math
import pathlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from gridmill.llm import ann, bpe, langid, lm, packing, pii, simhash, substring, syncmers, toxicity
from gridmill.llm.common import shared_folder

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, score string, fp string, part string"
VOCAB = "the of and cat dog sat mat run blue red über naïve 東京 привет".split()


def make_rows():
    rnd = random.Random(5)
    some = lambda n: " ".join(rnd.choice(VOCAB) + rnd.choice(["", "", ".", str(rnd.randint(0, 99))]) for _ in range(n))
    passage = some(60)
    texts = [some(rnd.randint(0, 90)) for _ in range(30)]
    texts += [passage, "x " + passage + " y", some(20) + " " + passage, passage]
    texts += [None, "", "   ", "\n\t", "a", "word " * 3000, "z" * 5000, "it's  we'll\r\n\x0b tabs\there ½² <|endoftext|> 🙂", texts[3], texts[3], "3.14 42 %%%"]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [(None, texts[3]), (None, None), (6, texts[2])]  # null ids, and a row that repeats
    return [(i, t, ["en", "de", None][k % 3], "s", None, "clash", "clash", "clash", "clash") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t, lower=False):
    b = (t or "").encode()
    return (b.lower() if lower else b).split()


def got(df):
    return collections.Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, empty, rows, encoding):
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = encoding.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got(bpe.byte_bpe_digests(docs, RANKS, public_tokenizers.PATTERN)) == want
    assert bpe.byte_bpe_digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_random(encoding):
    coder, rnd = bpe.ByteBPE(RANKS, public_tokenizers.PATTERN), random.Random(2)
    texts = ["".join(rnd.choice("ab '\ns.,1é½_\t日") for _ in range(rnd.randint(1, 90))) for _ in range(400)] + ["ab" * 400, "é" * 70]
    coded = coder.encode(texts)
    assert coded == [" ".join(map(str, encoding.encode_ordinary(t))) for t in texts]
    assert [coder.decode(c).decode() for c in coded] == texts


def test_bpe_forgets_long_pieces(monkeypatch):
    coder = bpe.ByteBPE(RANKS, public_tokenizers.PATTERN)
    rnd = random.Random(1)
    coded = coder.encode(["".join(rnd.choices("abcdefgh", k=300)) + " short" for _ in range(20)])
    assert all(coded) and max(map(len, [*coder.pieces, *coder.heads, *coder.tails])) <= bpe.LONGEST_HELD
    assert coder.held == sum(len(a) + len(b) for c in (coder.pieces, coder.heads, coder.tails) for a, b in c.items())
    monkeypatch.setattr(bpe, "MOST_HELD", 5)
    assert coder.encode(["one more"]) == bpe.ByteBPE(RANKS, public_tokenizers.PATTERN).encode(["one more"]) and not coder.pieces


def units(t):
    """Words of at most 32 characters, single characters of longer runs and of scripts without spaces, each with the spaces that follow."""
    import regex

    out, single = [], regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
    for run, spaces in regex.findall(r"([^ \t\n\x0b\f\r]*)([ \t\n\x0b\f\r]*)", t):
        word = len(run) <= 32 and not (run and single.match(run[0]))
        some = [run] if run and word else list(run)
        if some:
            some[-1] += spaces
        elif spaces:
            some = [spaces]
        out += some
    return out


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def chained(hashes):
    h = 42
    for x in hashes:
        h = xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), h)
    return signed(h)


def markers(t):
    h = [signed(xxhash.xxh64_intdigest(u.encode(), 42)) for u in units(t)]
    if len(h) < 6:
        return [(chained(h) % (1 << 64)) >> 24] if h else []
    mers = [chained(h[i : i + 2]) for i in range(len(h) - 1)]
    return [(chained(mers[i : i + 5 : 2]) % (1 << 64)) >> 24 for i in range(len(h) - 5) if min(mers[i], mers[i + 4]) <= min(mers[i + 1 : i + 4])]


def least(found):
    return sorted(set(found))[:64]


def near(a, b):
    both = sorted({*a, *b})[:64]
    return len(set(both) & set(a) & set(b)) / len(both) if a or b else 1.0


def test_syncmers(docs, empty, rows):
    """Fingerprints, edits, likenesses and alignments from their definitions."""
    found = syncmers.edited_fingerprints(docs).collect()
    assert len(found) == len(rows) and syncmers.edited_fingerprints(empty).count() == 0
    shown = lambda x: " ".join(f"{h:010x}@{x.index(h) + 1}" for h in least(x))
    order = sorted(((i, t or "") for i, t, *_ in rows if i is not None), key=lambda x: (x[0], signed(xxhash.xxh64_intdigest(x[1].encode(), 42))))
    want = collections.Counter()
    for k, (i, t) in enumerate([*order, *[(None, t or "") for i, t, *_ in rows if i is None]]):
        after = order[(k + 1) % len(order)][1] if i is not None else t
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = markers(t), markers(edited), markers(after)
        shifts = collections.Counter(b.index(x) - a.index(x) for x in set(least(a)) & set(least(b)))
        share = max(shifts.values()) / sum(shifts.values()) if shifts else 0.0
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), round(near(least(a), least(b)), 12), round(near(least(a), least(c)), 12), round(share, 12)] += 1
    got_ = collections.Counter((*tuple(r)[:5], *(round(x, 12) for x in tuple(r)[5:])) for r in found)
    assert got_ == want


def test_syncmers_of_text_without_spaces(spark):
    rnd = random.Random(3)
    han = "".join(chr(0x4E00 + rnd.randint(0, 3000)) for _ in range(2000))
    code = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=3000))
    df = spark.createDataFrame([(han, "新" + han), (code, "x" + code), (han, han[:900] + han[905:])], "a string, b string")
    likeness = syncmers.likeness(syncmers.sketch(syncmers.markers(F.col("a"))), syncmers.sketch(syncmers.markers(F.col("b"))))
    assert all(r[0] > 0.9 for r in df.select(likeness).collect())


def test_many_ranges(spark):
    starts = [k * 7 - 500 for k in range(1234)]
    df = spark.createDataFrame([(x,) for x in [-500, -499, -493, 0, 8131, 8132, 9000, *range(-400, 400, 13)]], "x long")
    assert all(n == sum(s <= x for s in starts) for x, n in df.select("x", syncmers.range_of(starts, F.col("x"))).collect())


def repeats_by_hand(rows, size):
    holders = collections.defaultdict(set)
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - size + 1 if i is not None else 0):
            holders[tuple(w[k : k + size])].add(i)
    want = collections.Counter()
    for i, t, *_ in rows:
        w = words(t)
        gone = bytearray(len(w))
        for k in range(len(w) - size + 1 if i is not None else 0):
            if min(holders[tuple(w[k : k + size])]) < i:
                gone[k : k + size] = b"\1" * size
        want[i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()] += 1
    return want


@pytest.mark.parametrize("size, hot", [(13, 1000), (13, 1), (2, 1000), (40, 1000)])
def test_substring(docs, empty, rows, monkeypatch, size, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    assert got(substring.repeats(docs, size)) == repeats_by_hand(rows, size)
    if size == 13:
        assert substring.repeats(empty, size).count() == 0


def test_windows_of_many_texts_at_once():
    """Pivots of a run of texts are those of each text by itself, and no window reaches into the next text; words hash alike wherever they stand."""
    rnd = random.Random(31)
    vocabulary = ["a", "b", "ab", "12345678", "123456789", "x" * 64, "x" * 65, "x" * 64 + "y", "é", "日本"]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randint(13, 60))) for _ in range(40)] + ["q " * 12 + "q"] * 2
    raws = [substring.plain(f"\t {t.replace(' ', rnd.choice([' ', chr(10), '  ']))} ") for t in texts]
    assert raws == [t.encode() for t in texts] and substring.plain(" \n") == b"" and substring.plain("a\u00a0b") == "a\u00a0b".encode()
    for size in (2, 13):
        windows, counts = substring.Windows(size), [len(r.split()) for r in raws]
        both, at, want = substring.Texts(raws, counts), 0, []
        for raw, n in zip(raws, counts, strict=True):
            alone = substring.Texts([raw], [n])
            assert both.hashes[at : at + n].tolist() == alone.hashes.tolist() and len(set(alone.hashes.tolist())) == len(set(raw.split()))
            grams = substring.gram_hashes(alone.hashes, windows.gram)
            least = [min((int(grams[i + j]) & ~255, j) for j in range(size - windows.gram + 1))[1] + i for i in range(n - size + 1)]
            starts = [i for i in range(len(least)) if i == 0 or least[i] != least[i - 1]]
            want += [(signed(int(grams[least[i]]) & ~1), at + i, at + j - 1) for i, j in zip(starts, [*starts[1:], len(least)], strict=True)]
            at += n
        assert list(zip(*(x.tolist() for x in windows.pivots(both)), strict=True)) == want


def test_substring_against_sql(spark, sf):
    import compare

    from gridmill.llm import queries

    assert compare.differences(queries.op3_substring_dedup(spark, sf), queries.ORACLE_SQL["op3_substring_dedup"], compare.duck(sf)) == ""


def test_automaton():
    rnd = random.Random(1)
    for _ in range(200):
        texts = [[rnd.choice("ab") for _ in range(rnd.randint(1, 9))] for _ in range(4)]
        a = substring.SuffixAutomaton()
        for i, t in enumerate(texts):
            a.add(t, i)
        a.finish()
        probe = [rnd.choice("abc") for _ in range(12)]
        for end, (n, first) in enumerate(a.statistics(probe, 5), 1):
            has = lambda m: [i for i, t in enumerate(texts) if any(t[k : k + m] == probe[end - m : end] for k in range(len(t) - m + 1))]  # noqa: E731, B023
            assert n == max(m for m in range(min(5, end) + 1) if m == 0 or has(m))
            assert n == 0 or first == min(has(n))


def test_reference(spark, docs):
    ref = spark.createDataFrame([(make_rows()[30][1],)], "text string")
    out = {r["doc_id"]: r["n_removed"] for r in substring.remove_reference(docs.filter("doc_id >= 90 and doc_id <= 99"), ref).collect()}
    assert out == {90: 60, 93: 60, 96: 60, 99: 60}
    with pytest.raises(ValueError):
        substring.remove_reference(docs, ref, most_words=1)


def test_remove_repeats(docs, rows):
    left = {r["doc_id"]: r["text"] for r in substring.remove_repeats(docs.filter("doc_id != 6"), 40).collect()}
    assert 99 not in left and left[93] == "x y" and left[90] == rows[30][1]


def test_stages_take_any_columns(spark, empty):
    """Names that the operators use themselves, empty tables, nulls and a very long text."""
    long_text = " ".join(f"w{i % 7000}" for i in range(200_000))
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(1, passage, 1, "a", "b"), (2, "x " + passage, 2, "a", "b"), (3, None, 3, "a", "b"), (4, "", 4, "a", "b"), (5, long_text, 5, "a", "b"), (None, passage, 6, "a", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id long, __text string, own string")
    out = {r["__id"]: r["text"] for r in substring.remove_repeats(df, 40).collect()}
    assert out == {1: passage, 2: "x ", 3: None, 4: "", 5: out[5], 6: passage} and len(out[5]) == len(long_text)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns and {r["__id"] for r in kept.collect()} == {1, 3, 5, 6}  # 2 is a near copy; no words at all make one document
    for stage in (lambda d: simhash.keep_first(d), lambda d: substring.remove_repeats(d, 40), lambda d: pii.replace_in_place(d, b"k")):
        assert stage(empty).count() == 0 and stage(empty).columns == empty.columns


def simhash_by_hand(t):
    w = words(t, True)
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def test_simhash(docs, empty, rows):
    fps = [simhash_by_hand(t) for _, t, *_ in rows]
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            root = [root[i] if r == root[j] else r for r in root]
    want = collections.Counter()
    for k, (i, *_) in enumerate(rows):
        ids = [r[0] for m, r in enumerate(rows) if root[m] == root[k] and r[0] is not None]
        want[i, f"{fps[k]:016x}", min(ids) if ids else None] += 1
    assert got(simhash.components(docs)) == want
    assert simhash.components(empty).count() == 0


def test_simhash_over_many_shards(spark, monkeypatch):
    """Chains of near fingerprints that run across the cuts between shards, against brute force."""
    monkeypatch.setattr(simhash, "SHARD", 20)
    rng = np.random.default_rng(8)
    points = [int(x) for x in rng.integers(0, 1 << 62, 300)]
    for k in range(0, 300, 3):  # walks of one or two bits a step
        p = points[k]
        for _ in range(int(rng.integers(1, 6))):
            for bit in rng.choice(64, int(rng.integers(1, 3)), replace=False):
                p ^= 1 << int(bit)
            points.append(p)
    fps = sorted(set(points))
    root = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    signed_ = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed_(p),) for p in fps], "fp long").repartition(4)
    links = [tuple(r) for r in simhash.links(df, 2).collect()]
    index = {signed_(p): i for i, p in enumerate(fps)}
    assert len(fps) > 400
    found = simhash.labels_of(len(fps), np.array([index[u] for u, _ in links]), np.array([index[v] for _, v in links]))
    assert found.tolist() == root
    joined = {r["u"]: r["v"] for r in simhash.stars(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all((joined.get(signed_(a), signed_(a)) == joined.get(signed_(b), signed_(b))) == (root[index[signed_(a)]] == root[index[signed_(b)]]) for a, b in zip(fps, fps[1:], strict=False))


def test_forest_is_exact():
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    points = np.unique(np.array([int(c) ^ 1 << int(b) ^ 1 << int(d) for c in centres for b, d in rng.integers(0, 63, (30, 2))], np.uint64))
    u, v = simhash.forest(points, np.zeros(0, np.uint64), 2)
    index = {int(p): i for i, p in enumerate(points.view(np.int64))}
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2)
    want = simhash.labels_of(len(points), i, j)
    got_ = simhash.labels_of(len(points), np.array([index[int(x)] for x in u], int), np.array([index[int(x)] for x in v], int))
    assert len(np.unique(want)) == len(np.unique(got_)) and all(want[a] == want[b] for a, b in zip([index[int(x)] for x in u], [index[int(x)] for x in v], strict=True))


@pytest.mark.parametrize(("block", "minima"), [(2_000, 3), (2, 3), (2_000, 0), (2, 0)])
def test_near_copies(spark, monkeypatch, block, minima):
    """Without minima all links come from rare shingles."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "MINIMA", minima)
    rnd = random.Random(3)
    base = [[f"w{rnd.randint(0, 500)}" for _ in range(150)] for _ in range(4)]
    texts = []
    for b in base:
        for n in (0, 0, 1, 2, 3, 4, 12):
            t = b.copy()
            for _ in range(n):
                t[rnd.randrange(150)] = "edit"
            texts.append(" ".join(t))
    texts += ["", " ", "short"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0])], "doc_id long, text string")
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert got(simhash.near_copies(df)) == collections.Counter([*enumerate(root), (None, None)])
    assert simhash.keep_first(df).count() == len(set(root)) + 1


def test_lm(docs, empty, rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [words(t, True) for i, t, *_ in rows if not held(i)]
    c = collections.Counter(itertools.chain(*train))
    n, v = sum(map(len, train)) + len(train), len(c) + 1
    want = sorted((i is None, i or 0, held(i), len(words(t)) + 1, sum(w in c for w in words(t, True)) + 1, n, round(sum(math.log10((c.get(w, 0) + 1) / (n + v + 1)) for w in words(t, True)) + math.log10((len(train) + 1) / (n + v + 1)), 6)) for i, t, *_ in rows)
    found = lm.score(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == want
    assert all(r["score"] < 0 for r in found)
    assert lm.score(empty).count() == 0


def test_lm_by_hand(docs, rows):
    """The suffix tree from its definition: counts, divergence tests, closure under suffixes, smoothing, the longest kept suffix."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    spoken = lambda t: b" ".join(words(t, True)) + b"\n"
    count = collections.defaultdict(collections.Counter)
    for i, t, *_ in rows:
        text = b"\n" * lm.DEPTH + spoken(t)
        for k in range(lm.DEPTH, len(text) if not held(i) else 0):
            for d in range(lm.DEPTH + 1):
                count[text[k - d : k]][text[k]] += 1
    own = {b for b, n in count[b""].items() if n >= lm.LEAST_COUNT} | {32, 10}
    sort = lambda b: b if b in own else None
    seen = {c: collections.Counter() for c in count}
    for c, n in count.items():
        for b, m in n.items():
            seen[c][sort(b)] += m
    kinds = [*own, None]

    def chance(context):
        if context not in memo:
            n, total, types = seen[context], sum(seen[context].values()), max(1, len(seen[context]))
            below = chance(context[1:]) if context else {b: ((256 - len(own)) if b is None else 1) / 256 for b in kinds}
            memo[context] = {b: (n[b] + types * below[b]) / (total + types) for b in kinds}
        return memo[context]

    memo: dict = {}
    kept = {b""}
    for c, n in seen.items():
        total = sum(n.values())
        if c and total >= lm.LEAST_COUNT:
            tells = sum(m / total * math.log(m / total / chance(c[1:])[b]) for b, m in n.items())
            if tells >= lm.LEAST_DIVERGENCE and tells * total >= lm.LEAST_GAIN:
                kept |= {c[k:] for k in range(len(c) + 1)}
    assert {len(c) for c in kept} >= {0, 1, 2}  # contexts of several lengths
    want = collections.Counter()
    for i, t, *_ in rows:
        text, score = b"\n" * lm.DEPTH + spoken(t), 0.0
        for k in range(lm.DEPTH, len(text)):
            context = next(text[k - d : k] for d in range(lm.DEPTH, -1, -1) if text[k - d : k] in kept)
            p = chance(context)[sort(text[k])]
            score += math.log10(p if text[k] in own else p / (256 - len(own)))
        want[i, round(score / len(text), 4)] += 1
    sizes = {}
    for i, t, *_ in rows:
        sizes.setdefault(i, []).append(len(spoken(t)) + lm.DEPTH)
    found = lm.score(docs).collect()
    assert len(found) == len(rows)
    single = {i for i, n in sizes.items() if len(n) == 1}
    assert all(want[r["doc_id"], x] or want[r["doc_id"], round(x + 1e-4, 4)] or want[r["doc_id"], round(x - 1e-4, 4)] for r in found if r["doc_id"] in single for x in [round(r["score"] / sizes[r["doc_id"]][0], 4)])


def test_suffix_tree_is_a_distribution():
    texts = [b"abab abba\n", b"abab\n", b"\n"] * 40
    codes, n = lm.gram_counts(texts)
    assert n.sum() == sum(map(len, texts))
    rows = []
    for d in range(lm.DEPTH + 1):
        part = codes & ((1 << (8 * (d + 1))) - 1)
        for code in np.unique(part):
            rows.append((d, int(code) >> 8, int(code) & 255, int(n[part == code].sum())))
    tree = lm.grow({k: np.array(c, np.int64) for k, c in zip(("d", "context", "symbol", "n"), zip(*rows, strict=True), strict=True)})
    assert len(tree.logp) > 1
    sizes = np.bincount(tree.classes, minlength=tree.logp.shape[1])
    assert np.allclose((10.0 ** tree.logp.astype(np.float64) * sizes).sum(axis=1), 1, atol=1e-4)
    assert tree.score([b"abab\n"])[0] > tree.score([b"bbbb\n"])[0]


def test_near_copies_of_other_repeats(spark):
    rnd, line, texts = random.Random(6), " ".join(f"line{i}" for i in range(9)), []
    for k in range(20):  # alike by about 0.98 as sets; another number of repeats
        base = [f"w{k}x{i}" for i in range(1000)]
        copy = base.copy()
        copy[rnd.randrange(1000)] = "edit"
        texts += [" ".join([*base, *[line] * 100]), " ".join([*copy, line])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert got(simhash.near_copies(df)) == collections.Counter((i, i - i % 2) for i in range(len(texts)))
    sets = [np.arange(0, 100, dtype=np.uint32), np.arange(5, 100, dtype=np.uint32), np.arange(60, 130, dtype=np.uint32)]
    far = np.array([0, (1 << 64) - 1, (1 << 32) - 1], np.uint64)  # no fingerprint is near another
    assert simhash.near_edges([1, 2, 3], far, sets, [False] * 3, 0.8)[1].tolist() == [0, 0, 2]
    assert simhash.near_edges([1, 2, 3], far, sets, [True] * 3, 0.8)[0] == []
    assert simhash.near_edges([1, 2, 3], far, sets, [True, False, False], 0.8)[0] == [(1, 2)]
    assert simhash.near_edges([1, 2, 3], far, sets, [False] * 3, 0.8, [7, 7, 9])[0] == []  # those two are joined already


@pytest.mark.parametrize(("block", "minima"), [(8, 3), (40, 3), (2_000, 3), (8, 0), (2_000, 0)])
def test_near_copies_with_a_common_passage(spark, monkeypatch, block, minima):
    """Unlike documents that share a long passage meet in large numbers; copies among them are found all the same, and only those."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "MINIMA", minima)
    rnd, passage = random.Random(12), " ".join(f"common{i}" for i in range(60))
    texts = []
    for k in range(60):
        own = [f"u{k}x{i}" for i in range(rnd.choice([20, 40, 80]))]
        for _ in range(rnd.choice([1, 1, 2, 3])):
            t = own.copy()
            t[rnd.randrange(len(t))] = f"edit{rnd.randint(0, 10**6)}"
            texts.append(passage + " " + " ".join(t))
    big = [f"big{i}" for i in range(100)]
    for _ in range(60):  # one large group
        t = big.copy()
        t[rnd.randrange(100)] = f"edit{rnd.randint(0, 10**6)}"
        texts.append(" ".join(t) + " " + passage)
    rnd.shuffle(texts)
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert got(simhash.near_copies(df)) == collections.Counter(enumerate(root))


def test_two_sets_alike_share_a_rare_member():
    rng = np.random.default_rng(6)
    counts = rng.integers(0, 1000, simhash.BUCKETS)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 32, rng.integers(1, 60), dtype=np.uint32))
        b = np.unique(np.concatenate([rng.choice(a, max(1, int(len(a) * rng.uniform(0.7, 1))), replace=False), rng.integers(0, 1 << 32, rng.integers(0, 6), dtype=np.uint32)]))
        if simhash.alike(a, b, 0.8):
            one, two = (set(simhash.prefix(a, counts, 0.8, k).tolist()) & set(simhash.prefix(b, counts, 0.8, k).tolist()) for k in (1, 2))
            assert one and (len(two) > 1 or min(len(a), len(b)) < 2)
            assert all(two - {k} for k in one) or min(len(a), len(b)) < 2  # with each of the one a second of the two


def test_near_copies_just_alike(spark):
    """Pairs alike by just 0.8 to 0.85: none is lost, though three minima miss many."""
    rnd, texts, want = random.Random(15), [], 0
    for k in range(150):
        a = [f"w{k}x{i}" for i in range(100)]
        b = a.copy()
        b[50:52] = [f"v{k}", f"v{k}y"]
        b += [f"t{k}x{i}" for i in range(rnd.randint(0, 14))]
        texts += [" ".join(a), " ".join(b)]
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for k in range(0, len(texts), 2):
        if len(sets[k] & sets[k + 1]) >= 0.8 * len(sets[k] | sets[k + 1]):
            root[k + 1] = k
            want += 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert got(simhash.near_copies(df)) == collections.Counter(enumerate(root)) and 50 < want < 150


def test_suffix_tree_keeps_what_tells(spark):
    rnd = random.Random(8)
    letters = [chr(c) for c in range(33, 65)] + list("abcdefgh")
    texts = ["".join(rnd.choices(letters, k=25_000)) for _ in range(100)] + ["qrstuv"] * 30  # over 60,000 contexts stand more often than the planted ones
    tree = lm.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    whole = lm.grow(lm.level_rows(*lm.gram_counts([lm.symbols(lm.words_of(t)) for t in texts]), range(lm.DEPTH + 1)))
    assert [len(x.contexts) for x in tree.levels] == [len(x.contexts) for x in whole.levels]
    asked = [b"qrstuv\n", b"abcdef gh\n"]
    assert np.allclose(tree.score(asked), whole.score(asked), atol=1e-5) and tree.score(asked)[0] > -2


def test_ann(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 16)).astype(np.float32)
    v[100:160] = v[7]
    data = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(900, None, 0), (950, [0.0] * 16, 0), (1000, [float("nan")] * 16, 0), (1050, [None] * 16, 0), (None, v[0].tolist(), 0), (3, v[3].tolist(), 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, rank int")
    found = collections.defaultdict(list)
    for r in ann.nearest(df, df.filter("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((round(-r["score"], 9), r["vec_id"]))
    ids = np.arange(400)
    full = v.astype(np.float64)
    want = ann.exact_nearest(full, ids, full[::50], ids[::50], 5)
    want = {q: [(round(c, 9), i) for c, i in w] for q, w in zip(ids[::50].tolist(), want, strict=True)}
    assert set(found) == set(want)
    hits = sum(len({i for _, i in found[q]} & {i for _, i in w}) for q, w in want.items())
    assert hits >= 0.95 * 40 and found[100] == want[100]
    few = df.filter("vec_id in (0, 1)")
    assert ann.nearest(few, few.filter("vec_id = 0"), 5).count() == 1
    assert ann.nearest(df.limit(0), df.limit(0), 5).count() == 0


def test_pii_text():
    act = pii.replacer(b"k")
    text = 'Mr. John Smith met Mrs Anna Kovač; Smith wrote to und.34@mail7.example.com, +1 (017) 555-7713, 97.51.17.173, 4111 1111 1111 1111!! token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" 123-45-6789'
    out, counts = act(text)
    assert counts == {"name": 3, "email": 1, "phone": 1, "ipv4": 1, "card": 1, "secret": 1, "ssn": 1}
    for secret in ("John", "Smith", "Anna", "Kovač", "und.34@", "555-7713", "97.51.17.173", "4111 1111", "04dbebab", "123-45-6789"):
        assert secret not in out
    surname = out.split()[2]
    assert out.count(surname) == 2 and out.split()[1] in pii.NAMES["m", "latin"] and out.split()[5] in pii.NAMES["f", "latin"]
    assert act(text) == (out, counts) and pii.replacer(b"other")(text)[0] != out
    assert act("nothing here at 5 of 7") == ("nothing here at 5 of 7", {}) and act("") == ("", {})


def test_surrogates_are_distinct():
    s = pii.Surrogates(b"k")
    ipv6 = [f"2001:db8::{i:x}" for i in range(1, 300)]
    iban = [f"GB{pii.iban_check(f'GB00WEST{i:014}'):02}WEST{i:014}" for i in range(100)]
    for kind, values in (("email", [f"a{i}@x.com" for i in range(100)]), ("phone", [f"+1 555 {i:03} 0000" for i in range(1000)]), ("ipv4", [f"10.0.0.{i}" for i in range(256)]), ("card", [f"411111111111{i:04}" for i in range(3000)]), ("ipv6", ipv6), ("iban", iban), ("name", [f"Ab{c}{d}" for c in "aeiou" for d in "bcdf"])):
        new = [s(kind, v) for v in values]
        assert len(set(new)) == len(values)
        assert all(s.same_sort(kind, a, b) and a != b and (len(a) == len(b) or kind in ("ipv4", "ipv6")) for a, b in zip(values, new, strict=True))
        assert all(pii._valid(kind, x) for x in new)
    for size in (1, 2, 37, 300):
        assert sorted(pii.permuted(i, size, b"k") for i in range(size)) == list(range(size))
        assert all(pii.permuted(pii.permuted(i, size, b"k"), size, b"k", back=True) == i for i in range(size))
        seen, at = set(), 0  # one cycle through all
        while at not in seen:
            seen.add(at)
            at = pii.following(at, size, b"k")
        assert len(seen) == size


def test_no_name_stays():
    for key in (b"k", b"public demonstration key"):
        s = pii.Surrogates(key)
        for (gender, script), names in pii.NAMES.items():
            new = [s.name(n) for n in names]
            assert sorted(new) == sorted(names) and all(a != b for a, b in zip(names, new, strict=True)), (gender, script)
        for word in "Smith Żółć Řezníček Παπαδόπουλος 王小明 田中 김철수 כהן محمد Ёлкин Xanthe".split():
            new = s.name(word)
            assert new != word and len(new) == len(word) and pii.script_of(new) == pii.script_of(word)


def test_one_entity_in_two_forms():
    act = pii.replacer(b"k")
    digits = lambda t: "".join(c for c in t if c.isdigit())
    new = [act(x)[0] for x in ("+15551234567", "+1 555 123 4567", "555-123-4567", "(555) 123-4567")]
    assert {digits(x)[-10:] for x in new} == {digits(new[0])[-10:]} and new[0].startswith("+1") and new[1].startswith("+1 ") and digits(new[0]) != "15551234567"
    assert digits(act("+44 (0)20 7946 0958")[0]) == "44" + "0" + digits(act("+442079460958")[0])[2:]
    assert act("John.Doe@x.com")[0].lower() == act("john.doe@x.com")[0]
    assert act("4111 1111 1111 1111")[0].replace(" ", "") == act("4111111111111111")[0]
    assert act("GB82 WEST 1234 5698 7654 32")[0].replace(" ", "") == act("GB82WEST12345698765432")[0]
    a, b, c = (act(x)[0] for x in ("2001:db8::8a2e:370:7334", "2001:0db8:0000:0000:0000:8a2e:0370:7334", "2001:DB8::8A2E:370:7334"))
    assert ipaddress.ip_address(a) == ipaddress.ip_address(b) == ipaddress.ip_address(c) != ipaddress.ip_address("2001:db8::8a2e:370:7334") and "::" in a and len(b) == 39 and c.isupper() is True
    assert act("at 12:30:45 std::vector a::b")[1] == {}


def test_names_and_gender():
    act = pii.replacer(b"k")
    out, counts = act("Call John Smith. Mrs Xanthe Doe came; Xanthe left. Mr Xanthos Doe. Dr 王小明 and 田中さん, г-н Иван Петров")
    words = out.replace(";", "").replace(".", "").split()
    assert words[1] in pii.NAMES["m", "latin"] and words[1] != "John" and "Smith" not in out and counts == {"name": 7}
    assert words[4] != "Xanthe" and words[4][-1] == "e" and words[7] == words[4] and words[10][-1] == "s" and words[10] != "Xanthos" and words[5] == words[11]
    assert words[-2] in pii.NAMES["m", "cyrillic"] and words[-2] != "Иван" and "王小明" not in out and "田中" not in out
    assert act("Anna came home") == ("Anna came home", {})  # a given name alone is not taken for a person


def test_pii_rows(docs, empty, rows):
    found = pii.replace(docs, b"k").collect()
    assert len(found) == len(rows) and sum(r["text"] is None for r in found) == 2 and pii.replace(empty, b"k").count() == 0
    assert sorted(map(str, pii.replace_in_place(docs, b"k").columns)) == sorted(docs.columns) and pii.replace_in_place(empty, b"k").count() == 0


def test_pii_by_hand(spark):
    """Every planted entity of a made corpus is gone, all else stays, and an entity has one surrogate in all documents."""
    rnd = random.Random(9)
    kinds = {"email": ["ann.lee@mail.example", "bob_7@x.org"], "phone": ["+1 415 555 0100", "+49 30 123456"], "ipv4": ["8.8.4.4", "172.16.0.9"], "ssn": ["123-45-6789", "987-65-4321"], "card": ["4111 1111 1111 1111", "4242424242424242"]}
    lines = []
    for i in range(60):
        parts, wanted = [], []
        for _ in range(rnd.randint(0, 5)):
            kind = rnd.choice(sorted(kinds))
            value = rnd.choice(kinds[kind])
            parts += [" ".join(rnd.choices(["plain", "words", "at", "5", "of", "2024"], k=4) + ["is"]), "\0" + value + "\0"]
            wanted.append((kind, value))
        lines.append((i, "".join(f"{p} and " for p in parts) + "end", wanted))
    df = spark.createDataFrame([(i, t.replace("\0", "")) for i, t, _ in lines], "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r for r in pii.replace(df, b"k").collect()}
    s = pii.Surrogates(b"k")
    for i, t, wanted in lines:
        want = t
        for kind, value in wanted:
            want = want.replace("\0" + value + "\0", s(kind, value), 1)
        assert out[i]["text"] == want and out[i]["n_entities"] == len(wanted)


def test_collisions(spark):
    df = spark.createDataFrame([(f"a{i}@x.com and 10.0.0.{i % 50} and A{i}@X.com",) for i in range(100)], "text string")
    assert {r["kind"]: (r["entities"], r["surrogates"]) for r in pii.check_collisions(df, b"k").collect()} == {"email": (100, 100), "ipv4": (50, 50)}
    odd = spark.createDataFrame([(None, 1), ("", 2), ("John Smith. " * 30_000, 3)], "text string, kind int")
    assert {r["kind"]: (r["entities"], r["surrogates"]) for r in pii.check_collisions(odd, b"k").collect()} == {"name": (1, 1), "name word": (2, 2)}
    assert pii.check_collisions(df.limit(0), b"k").count() == 0


def test_names_stay_apart_and_together(spark):
    """Given names and surnames of all forms, with and without titles, in capitals, over documents: as many surrogates as names, a person one."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("bdklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 2))).capitalize() + rnd.choice(["", "n", "ina", "us"])
    people = [(word(), word()) for _ in range(1500)] + [("Kim", "Doe"), ("Jem", "Paxiha"), ("Jemina", "Medina")]
    titles = ["Mrs", "Mr", "Dr"]
    rows = [(f"{rnd.choice(titles)} {a} {b} met {rnd.choice(titles)}. {b} and Dr {a.upper()} {b.upper()}",) for a, b in people for _ in range(2)]
    df = spark.createDataFrame(rows, "text string").repartition(4)
    got_ = {r["kind"]: (r["entities"], r["surrogates"]) for r in pii.check_collisions(df, b"k").collect()}
    listed = sum(x in pii.GENDER_OF for p in people for x in p)
    assert got_["name word"] == (len({x for p in people for x in p}),) * 2 and got_["name"][0] == got_["name"][1] and listed < 50
    act = pii.replacer(b"k")
    a, b, c = (act(t)[0].split()[1:3] for t in ("Mrs Kim Doe", "Dr Kim Doe", "Mr KIM DOE"))
    assert a == b == [canon.capitalize() for canon in c] and c[0].isupper()


def test_what_is_found():
    act = pii.replacer(b"k")
    gone = lambda t, *secrets: not [x for x in secrets if x in act(t)[0]]
    assert gone("Mr. O'Brien said O'Brien's car and OBRIEN", "O'Brien") and act("Mr. O'Brien said O'Brien's car")[0].endswith("'s car")
    assert gone("My name is Xavier Dupont. Ich heiße Uwe", "Xavier", "Dupont", "Uwe")
    assert gone("MARIA LOPEZ signed; Maria Lopez too", "MARIA", "LOPEZ", "Maria", "Lopez")
    one, two = act("MARIA LOPEZ signed; Maria Lopez too")[0].split(" signed; ")
    assert one.title() == two.removesuffix(" too")
    assert gone("call 020 7946 0958 or 06 12 34 56 78", "7946", "34 56") and act("call 020 7946 0958")[0].startswith("call 0")
    assert gone("write to jürgen.müller@exämple.de now", "jürgen", "exämple")
    for clean in ("Paul Revere Street", "MARK ALL ITEMS", "on 01.02.2024 at 06 12 2024", "0.123 and 0-306-40615-2", "my name is not known"):
        assert act(clean) == (clean, {}), clean


def test_langid(spark, docs, empty, rows):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (r.lang_pred == r.lang).mean() > 0.97 and r.score.between(0, 1).all()
    odd = langid.identify(docs).collect()
    assert len(odd) == len(rows) and langid.identify(empty).count() == 0
    blank = [t for _, t, *_ in rows if not t or not any(c.isalpha() for c in t)]
    assert sum(x["lang_pred"] == "und" for x in odd) == len(blank)


def test_keep_identified(docs, empty, rows):
    said = collections.Counter((r["doc_id"], r["lang_pred"]) for r in langid.identify(docs).filter("lang_pred != 'und' and score >= 0.4").collect())
    kept = langid.keep_identified(docs).collect()
    assert collections.Counter(r["doc_id"] for r in kept) == collections.Counter(i for (i, _), n in said.items() for _ in range(n))
    assert all(r["lang"] is not None and r["part"] == "clash" for r in kept) and {r["lang"] for r in kept} <= {"en", "de"}
    assert langid.keep_identified(empty).count() == 0 and langid.keep_identified(empty).columns == docs.columns


def test_langid_by_hand(spark):
    """The kernel from sets of strings and plain linear algebra, on three made languages of three scripts and cases."""
    rnd = random.Random(11)
    letters = {"a": "abcdeÁé", "b": "bcdfgZ", "г": "абвгДЖ"}
    made = [(i, " ".join("".join(rnd.choices(letters[lang], k=rnd.randint(1, 6))) for _ in range(rnd.randint(1, 30))) + rnd.choice(["", " 12!", "\n"]), lang) for i in range(150) for lang in [rnd.choice(list(letters))]]
    df = spark.createDataFrame([*made, (900, "123", "a"), (901, None, "b"), (902, "abc", None)], "doc_id long, text string, lang string").repartition(3)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df).collect()}

    def grams_of(t):
        t = "".join(c.lower() if c.isalpha() else " " for c in f" {t} ")
        t = " ".join(["", *t.split(), ""])
        return {t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)}

    order = {r["doc_id"]: r["h"] for r in df.selectExpr("doc_id", "xxhash64(doc_id, text) h").collect()}
    train = sorted(((lang, order[i], grams_of(t)) for i, t, lang in made if zlib.crc32(str(i).encode()) % 5), key=lambda x: x[:2])
    names = sorted(letters)
    marks = [g for lang in names for g in [g for x, _, g in train if x == lang][:32]]
    used = set().union(*marks)
    kernel = lambda g, m: len(g & m) / math.sqrt(max(1, len(g & used)) * len(m))
    value, vector = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    keep = value > 1e-6 * value.max()
    whiten = vector[:, keep] / np.sqrt(value[keep])
    features = lambda g: np.array([*(np.array([kernel(g, m) for m in marks]) @ whiten), 1.0])
    x, y = np.array([features(g) for _, _, g in train]), np.array([[1.0 if lang == name else -1.0 for name in names] for lang, _, _ in train])
    count = collections.Counter(lang for lang, _, _ in train)
    w = np.array([1 / count[lang] for lang, _, _ in train])
    w *= len(w) / w.sum()
    weights = np.linalg.solve(x.T @ (w[:, None] * x) + 1e-4 * len(x) * np.eye(x.shape[1]), x.T @ (w[:, None] * y))
    for i, t, _ in [*made, (902, "abc", None)]:
        s = features(grams_of(t)) @ weights
        p = np.exp(4 * (s - s.max()))
        p /= p.sum()
        assert found[i][0] == names[int(p.argmax())] and abs(found[i][1] - p.max()) < 0.02
    assert found[900] == found[901] == ("und", 0.0)


def test_landmarks_by_holders(monkeypatch):
    """Kernel values from sets of strings, with landmarks laid out a few n-grams at a time; a text of no known n-gram, and an empty one."""
    rnd = random.Random(5)
    text = lambda: "".join(rnd.choices("abcdefgh  ", k=rnd.randint(5, 60)))
    known = [(np.unique(langid.grams(langid.folded(text()), 4)), str(i % 3)) for i in range(90)]
    model = langid.fit(known, landmarks_each=7)
    marks = [set(c.tolist()) for lang in "012" for c in [c for c, x in known if x == lang][:7]]
    used = set().union(*marks)
    held = [langid.grams(langid.folded(t), 4) for t in [text() for _ in range(40)] + ["", "ЖЖЖ"]]
    want = [[len(g & m) / math.sqrt(max(1, len(g & used)) * len(m)) for m in marks] for g in (set(h.tolist()) for h in held)]
    assert np.allclose(model.kernel(held), want, atol=1e-6)
    monkeypatch.setattr(langid, "LAID_OUT", 500)
    assert np.allclose(model.kernel(held), want, atol=1e-6)


def test_many_languages(spark, monkeypatch):
    """Three hundred labels, most of them junk: the frequent ones are learned, and landmarks and drawn texts stay bounded."""
    rnd = random.Random(8)
    letters = [chr(0x430 + i) * 2 + chr(0x61 + i % 26) + chr(0x3B1 + i % 17) for i in range(40)]
    rows = [(i, " ".join("".join(rnd.choices(letters[i % 40], k=rnd.randint(2, 7))) for _ in range(12)), f"l{i % 40:02}") for i in range(1600)]
    rows += [(10_000 + i, rnd.choice(rows)[1], f"junk{i}") for i in range(260)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "MOST_LANDMARKS", 200)
    monkeypatch.setattr(langid, "MOST_DRAWN", 400)
    drawn = langid.training_rows(df, 300, "doc_id", "text", "lang", 40)
    assert {lang for _, lang in drawn} == {f"l{i:02}" for i in range(40)} and len(drawn) <= 800
    model = langid.fit(drawn)
    assert len(model.norms) == 200 and model.begins[-1] == len(model.holders) == (model.norms.astype(np.float64) ** 2).round().sum()
    said = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, most_languages=40).collect()}
    assert np.mean([said[i] == lang for i, _, lang in rows[:1600]]) > 0.95 and not any(x.startswith("junk") for x in said.values())


def test_packing(docs, empty, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # as it is: <|endoftext|> in a text is its own id
    special = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter(tuple([*tok.encode(t or "", add_special_tokens=False).ids, 0]) for _, t, *_ in rows)
    assert any(50256 in ids for ids in want)
    out = packing.pack(docs, RANKS, public_tokenizers.PATTERN, longest=256, step_tokens=1024, special=special, ids=True).toPandas()
    seqs = out.sort_values(["sequence_id", "offset"])
    for _, g in seqs.groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == g.window.iloc[0] <= 256 and g.step_group.nunique() == 1
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in out.itertuples())
    one = out[out.groupby("doc_id").doc_tokens.transform("sum") > 0]
    for doc, g in one.groupby("doc_id"):
        if doc != 6 and not math.isnan(doc):
            g = g.sort_values("start")
            whole = tuple(itertools.chain(*g.ids))
            assert want[whole] and len(whole) == g.doc_tokens.iloc[0] and g.start.tolist() == [0, *np.cumsum(g.length)[:-1]]
    assert out.length.sum() == sum(len(k) * n for k, n in want.items())
    assert packing.pack(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_tiers_and_steps():
    rnd = random.Random(4)
    lengths = [rnd.choice([rnd.randint(1, 128), rnd.randint(129, 256), rnd.randint(257, 512), rnd.randint(513, 3000)]) for _ in range(20_000)]
    packer, steps, windows = packing.Packer(1024), packing.Steps(65_536), []
    for key, n in enumerate(lengths):
        windows += packer.add(key, n)
        assert packer.waiting <= packing.MOST_WAITING
    early = len(windows)
    windows += packer.rest()
    counts = collections.Counter(w for w, _ in windows[:early])
    assert set(counts) == {1024, 512, 256, 128}  # each tier is packed
    pieces = collections.defaultdict(list)
    for window, held in windows:
        assert sum(n for _, _, n in held) == window and window & (window - 1) == 0
        for key, start, n in held:
            pieces[key].append((start, n))
    for key, n in enumerate(lengths):
        assert [s for s, _ in sorted(pieces[key])] == [0, *itertools.accumulate(m for _, m in sorted(pieces[key]))][:-1] and sum(m for _, m in pieces[key]) == n
    dealt = [x for window, held in windows for x in steps.add(window, held)]
    full = len(dealt)
    dealt += steps.rest()
    assert len(dealt) == len(windows)
    tokens, cost = collections.Counter(), collections.Counter()
    for group, window, held in dealt[:full]:
        tokens[window, group] += window
        cost[window, group] += sum(n * n for _, _, n in held)
    assert set(tokens.values()) == {65_536}
    for window in {w for w, _ in cost}:
        for first in range(0, max(g for w, g in cost if w == window), packing.GROUPS):
            together = [cost[window, g] for g in range(first, first + packing.GROUPS)]
            assert max(together) <= 1.1 * min(together)


def test_packing_of_a_million_spaces(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = "a" + " " * 1_000_000 + "b\n" + "\n" * 20_000 + "end"
    out = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN, ids=True).orderBy("start").collect()
    ids = [i for r in out for i in r["ids"]]
    coder = packing.TokenBytes(RANKS, public_tokenizers.PATTERN)
    assert coder.encoding.decode(ids[:-1]) == text
    short = text.replace(" " * 1_000_000, " " * 12_000)
    assert np.frombuffer(coder.of(short), "<u4").tolist() == tok.encode(short, add_special_tokens=False).ids


def test_toxicity(spark, docs, empty, rows):
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    r = toxicity.score(df, labels).join(labels, "doc_id").filter("held_out").toPandas()
    hit, alarm = r[(r.toxic == 1)].predicted.mean(), r[(r.toxic == 0)].predicted.mean()
    assert hit > 0.85 and alarm < 0.01 and r.score.between(0, 1).all()
    assert toxicity.score(docs, labels.limit(0)).count() == len(rows) and toxicity.score(empty, labels).count() == 0


def learned(rows, **more):
    return toxicity.fit([toxicity.terms(t) for t, _ in rows], [k for _, k in rows], **more)


def test_machine_learns_a_pair():
    rnd, rows = random.Random(0), []
    for _ in range(600):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        rows.append((" ".join(["insult"] * a + ["group"] * b + [f"w{rnd.randint(0, 20)}" for _ in range(5)]), int(a and b)))
    m = learned(rows, passes=40)
    both, one, other = m.predict(["insult group", "insult", "group"])
    assert both > 0.8 > 0.3 > max(one, other)


def test_machine_learns_what_no_term_tells():
    """Labels of exactly one of two terms: each term alone is as frequent in both classes, and no linear weights can tell them."""
    rnd, rows = random.Random(3), []
    letters = lambda: "".join(rnd.choices("abcdefgh", k=4))
    vocabulary = [letters() for _ in range(300)]
    for _ in range(2000):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        rows.append((" ".join(["insult"] * a + ["group"] * b + rnd.choices(vocabulary, k=8)), int(a != b)))
    held = [toxicity.terms(t) for t, _ in rows]
    y = np.array([k for _, k in rows], float)
    seen = np.unique(np.concatenate(held))
    assert not set(toxicity.terms("insult group").tolist()) & set(toxicity.telling(held, y, seen, 12.0).tolist())
    m = learned(rows)
    one, other, both, none = m.predict(["insult", "group", "insult group", "abcd"])
    assert min(one, other) > 0.6 > 0.3 > max(both, none)


def test_machine_by_hand():
    """A machine's answer is its bias, weights and all pairs of factors, term by term."""
    rnd = random.Random(1)
    rows = [(" ".join(rnd.choices("bad good you they fine awful nice the of and".split(), k=rnd.randint(0, 12))), rnd.randint(0, 1)) for _ in range(300)]
    m = learned(rows, least_chi2=0.0)
    for t, p in zip([t for t, _ in rows], m.predict([t for t, _ in rows]), strict=True):
        used = [int(m.row[k]) for k in toxicity.terms(t).tolist() if m.row[k] >= 0]
        raw = m.bias + sum(m.weight[i] for i in used) + sum(float(m.factor[i] @ m.factor[j]) for i, j in itertools.combinations(used, 2))
        assert abs(1 / (1 + math.exp(-raw)) - p) < 1e-9


def test_pipeline(spark):
    import corpus_pipeline as p

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = df.unionAll(df.limit(1).selectExpr("cast(100000 as bigint) doc_id", "'123 %%%' text", "lang", "source", "n_chars")).unionAll(df.filter("doc_id = 5").selectExpr("cast(100001 as bigint) doc_id", "text", "lang", "source", "n_chars"))
    kept = docs
    for name, stage in p.STAGES[:-1]:
        kept = stage(spark, kept, "/root/testdata/sf0.001")
        assert kept.columns == docs.columns, name
    ids = {r[0] for r in kept.select("doc_id").collect()}
    assert 100000 not in ids and not {5, 100001} <= ids and len(ids) > 150
    out = p.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and p.ORACLE_SQL is None


def test_ann_of_many_shards(spark, monkeypatch):
    """Tight clusters, copies at other lengths and spread vectors over many shards, against brute force."""
    monkeypatch.setattr(ann, "SHARD", 300)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1200, 24))
    for k, eps in enumerate((1e-9, 1e-6, 1e-4, 1e-3, 1e-2)):
        v[100 + 60 * k : 160 + 60 * k] = v[k] + eps * rng.normal(size=(60, 24))
    v[500:560] = v[7] * 2.0 ** np.arange(1, 61)[:, None]
    ids = np.arange(1200)
    assert ann.shards_for(1200) == 3  # SHARD counts until the roots do
    monkeypatch.setattr(ann, "GROWTH", 1)
    assert ann.shards_for(1200) == 4
    df = spark.createDataFrame([(int(i), x.tolist(), "clash", 1.0) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>, shard string, score double").repartition(5)
    asked = df.filter("vec_id % 20 = 0 or vec_id = 7")
    found = collections.defaultdict(list)
    for r in ann.nearest(df, asked, 5).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["score"], r["vec_id"]))
    rows = np.array([i for i in ids if i % 20 == 0 or i == 7])
    want = dict(zip(rows.tolist(), ann.exact_nearest(v, ids, v[rows], rows, 5), strict=True))
    assert set(found) == set(want) and all(len(x) == 5 for x in found.values())
    hits = sum(score >= -want[q][-1][0] - 1e-15 for q, some in found.items() for score, _ in some)
    print("recall", hits / (5 * len(want)))
    assert hits >= 0.97 * 5 * len(want)
    assert [i for _, i in found[7]] == [500, 501, 502, 503, 504]
    truth = lambda q, i: float(v[q] @ v[i] / (np.linalg.norm(v[q]) * np.linalg.norm(v[i])))
    assert all(abs(score - truth(q, i)) < 1e-12 for q, some in found.items() for score, i in some)


def test_nodes_hold_all_rows():
    rng = np.random.default_rng(3)
    units = ann.unit(np.repeat(rng.normal(size=(50, 8)), 20, axis=0) + 1e-4 * rng.normal(size=(1000, 8)))
    heads, of = ann.nodes(units)
    assert ((units * units[heads[of]]).sum(axis=1) >= 1 - ann.NEAR - 1e-12).all() and (of[heads] == np.arange(len(heads))).all()
    apart = units[heads] @ units[heads].T - np.eye(len(heads))
    assert (apart < 1 - ann.NEAR + 1e-12).all()


def test_a_megabyte_of_text(spark):
    """Very long texts, as many words and as one run, beside short ones: every operator answers for each row, whole texts read."""
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnoprstu", k=rnd.randint(2, 9))) for _ in range(5000)]
    prose = " ".join(rnd.choices(vocabulary, k=150_000))
    run, han = "".join(rnd.choices("abcdefghij+/", k=1_000_000)), "".join(chr(0x4E00 + rnd.randint(0, 2000)) for _ in range(200_000))
    texts = [prose, run, han, "short text", prose + " and an end"]
    df = spark.createDataFrame([(i, t, ["en", "xx", "zh", "en", "en"][i], "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    coded = {r["doc_id"]: r for r in bpe.byte_bpe_digests(df, RANKS, public_tokenizers.PATTERN).collect()}
    assert all(coded[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts))
    near = {r["doc_id"]: r for r in syncmers.edited_fingerprints(df).collect()}
    assert [near[i]["n_chars"] for i in range(5)] == list(map(len, texts))
    gone = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.repeats(df).collect()}
    assert gone == {0: (150_000, 0), 1: (1, 0), 2: (1, 0), 3: (2, 0), 4: (150_003, 150_000)}
    assert {r["doc_id"]: r["component_id"] for r in simhash.components(df).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}
    assert {r["doc_id"]: r["n_tokens"] for r in lm.score(df).collect()} == {0: 150_001, 1: 2, 2: 2, 3: 3, 4: 150_004}
    assert {r["doc_id"]: r["text"] for r in pii.replace(df, b"k").collect()} == dict(enumerate(texts))
    assert langid.identify(df).count() == 5 and toxicity.score(df, labels).count() == 5
    packed = packing.pack(df, RANKS, public_tokenizers.PATTERN).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == {i: r["n_tokens"] + 1 for i, r in coded.items()}


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as p

    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    out = p.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns


def test_pipeline_by_hand(spark, tmp_path):
    """The whole pipeline against its stages done by hand on a small table."""
    import corpus_pipeline as p

    rnd = random.Random(21)
    english, german = "the and of to in that was for with his".split(), "der die und das ist nicht ein mit sich auf".split()
    line = lambda v, n: " ".join(rnd.choices(v, k=n - n // 3) + [f"{v[0]}{rnd.randint(0, 9999)}" for _ in range(n // 3)])
    passage = line(english, 50)
    texts = [line(english if i % 2 else german, 80) for i in range(40)]
    texts += [passage + " " + line(english, 60), line(english, 60) + " " + passage, texts[3], texts[4].rsplit(" ", 1)[0], "12345 %%%", None, passage, texts[5] + " call +1 555 123 4567"]
    rows = [(i, t, "en" if t and t.split()[0].startswith(tuple(english)) else "de", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    said = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df).collect()}
    kept = {i: t for i, t, *_ in rows if said[i][0] != "und" and said[i][1] >= 0.4}
    assert not {44, 45} & kept.keys() and len(kept) > 40
    sets = {i: set(simhash.shingle_set(t, 5).tolist()) for i, t in kept.items()}
    for i in sorted(kept, reverse=True):  # copies here are of one text each
        if any(j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in kept):
            del kept[i]
    assert not {42, 43} & kept.keys()
    before, found = dict(kept), {}
    for i, t in before.items():
        w, gone = words(t), set()
        for k in range(len(w) - 39):
            if any(j < i and b" ".join(w[k : k + 40]) in b" ".join(words(u)) for j, u in before.items()):
                gone.update(range(k, k + 40))
        left = substring.without(t, np.array([k in gone for k in range(len(w))]))
        if not w or len(gone) < len(w):
            found[i] = left
    assert 46 not in found and len(words(found[41])) == 60 and len(words(found[40])) == 110
    act = pii.replacer(p.surrogate_key(spark))
    want = {i: len(packing.TokenBytes(RANKS, public_tokenizers.PATTERN, packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))).of(act(t)[0])) // 4 + 1 for i, t in found.items()}
    out = p.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r["doc_id"]: r["n"] for r in out} == want == {r["doc_id"]: r["all"] for r in out}


def test_tree_that_is_not_fetched(spark, docs, empty, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r["doc_id"]: r for r in lm.score(df).collect()}
    odd = sorted((str(r["doc_id"]), r["score"]) for r in lm.score(docs).collect())
    monkeypatch.setattr(lm, "MOST_FETCHED", 0)
    got_ = {r["doc_id"]: r for r in lm.score(df).collect()}
    assert got_.keys() == want.keys()
    assert all(abs(got_[i]["score"] - want[i]["score"]) < 1e-5 * abs(want[i]["score"]) and got_[i]["n_known"] == want[i]["n_known"] and abs(got_[i]["base_score"] - want[i]["base_score"]) < 1e-9 * abs(want[i]["base_score"]) for i in want)
    asked = sorted((str(r["doc_id"]), r["score"]) for r in lm.score(docs).collect())
    assert [i for i, _ in asked] == [i for i, _ in odd] and np.allclose([x for _, x in asked], [x for _, x in odd], rtol=1e-5)
    assert lm.score(empty).count() == 0


def test_outlines_show_no_alike_pair_as_unlike():
    rng = np.random.default_rng(9)
    for n in (3, 40, 900, 60_000):
        sets = []
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint32))
            for share in (1, 0.97, 0.9, 0.8, 0.5):
                sets.append(np.unique(np.concatenate([rng.choice(a, max(1, int(len(a) * share)), replace=False), rng.integers(0, 1 << 32, int(n * (1 - share) / 3), dtype=np.uint32)])))
        size, drawn = np.array(list(map(len, sets))), np.array([simhash.outline(x) for x in sets])
        i, j = simhash.may_be_alike(size, drawn, np.arange(len(sets)), 0.8, slice(0, len(sets)))
        left = set(zip(i.tolist(), j.tolist(), strict=True))
        alike = {(p, q) for p, q in itertools.combinations(range(len(sets)), 2) if simhash.alike(sets[p], sets[q], 0.8)}
        assert alike <= left and len(alike) > 5 and (n > 10_000 or len(left) < 0.6 * len(sets) ** 2 / 2)


def test_outlines_tell_unlike_sets_of_any_size():
    """Unlike sets of like sizes are not sent to be compared, however large; outlines of two lengths are folded."""
    rng = np.random.default_rng(10)
    for n in (300, 1_000, 5_000, 60_000):
        sets = [np.unique(rng.integers(0, 1 << 32, int(n * rng.uniform(0.85, 1.15)), dtype=np.uint32)) for _ in range(12)]
        sets += [np.unique(np.concatenate([x[: len(x) * 9 // 10], rng.integers(0, 1 << 32, len(x) // 20, dtype=np.uint32)])) for x in sets[:6]]
        sets += [np.unique(np.concatenate([x[: len(x) * 3 // 4], rng.integers(0, 1 << 32, len(x) // 4, dtype=np.uint32)])) for x in sets[6:12]]  # alike by 0.6
        size, drawn = np.array(list(map(len, sets))), [simhash.outline(x) for x in sets]
        left = set(zip(*(x.tolist() for x in simhash.may_be_alike(size, drawn, np.arange(len(sets)), 0.8, slice(0, len(sets)))), strict=True))
        assert left == {(k, 12 + k) for k in range(6)} and sum(x.nbytes for x in drawn) <= max(4 * 32 * len(sets), sum(x.nbytes for x in sets) / 16)


def test_near_copies_leave_nothing_behind(spark):
    """Sets and meetings are deleted when the groups are known; what stays is small."""
    folder = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    before, rnd = set(folder.iterdir()), random.Random(3)
    df = spark.createDataFrame([(i, " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(3_000))) for i in range(60)], "doc_id long, text string")
    found = simhash.near_copies(df)
    left = sum(f.stat().st_size for top in set(folder.iterdir()) - before for f in top.rglob("*") if f.is_file())
    assert left < 60 * 3_000 * 4 / 10 and not [t for t in spark.catalog.listTables() if t.name.startswith("near_")]
    assert got(found) == collections.Counter((i, i) for i in range(60))
