"""Periodic runs, embedding whitening and byte-level BPE against plain forms, the library and numpy."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute import WORD, sha
from pyspark.sql import functions as F

from quillmesh.llm import periodic_runs, queries, rank_queue, whitening

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = rank_queue.load(VOCABULARY).ranks.ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(text):
    return np.frombuffer(rank_queue.encode_texts([text], rank_queue.load(VOCABULARY))[0], "<u4").tolist()


# ---------------------------------------------------------------- byte-level BPE


def test_queue_gives_ranks_in_order():
    queue, rng, wanted = rank_queue.RankQueue(5000), random.Random(3), {}
    for rank in rng.sample(range(5000), 700):
        wanted[rank] = rng.sample(range(100), 5)
        queue.put(rank, list(wanted[rank]))
    taken = []
    while queue.top:
        rank, positions = queue.take()
        assert positions == sorted(wanted[rank])
        taken.append(rank)
        if len(taken) == 100:  # a lower rank that comes late is next
            queue.put(0, [1])
            wanted[0] = [1]
            assert queue.take()[0] == 0
    assert taken == sorted(wanted.keys() - {0} | ({0} & set(taken)))


@pytest.mark.parametrize("chunk", [64, rank_queue.CHUNK])
def test_byte_bpe_equals_the_library(monkeypatch, library, chunk):
    monkeypatch.setattr(rank_queue, "CHUNK", chunk)
    rng = random.Random(7)
    letters = "aab bcé  \n\t'strevmlld 123 中文ع한😀\x1c\x85\xa0²½_-<|endoftext|>"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(400))) + "a" * rng.randrange(80)
        assert ids_of(text) == library.encode_ordinary(text), text


def test_byte_bpe_knows_every_character_as_the_library_does(library):
    around = [f"a{c}1 {c}{c} b {c}" for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    texts = ["".join(around[k : k + 256]) for k in range(0, len(around), 256)]
    mine = rank_queue.encode_texts(texts, rank_queue.load(VOCABULARY))
    assert [np.frombuffer(m, "<u4").tolist() for m in mine] == library.encode_ordinary_batch(texts)


def test_byte_bpe_of_very_long_words(library):
    rng = random.Random(1)
    for text in ("a" * 30_000, "ab" * 20_000, "".join(rng.choice("abcdefgh") for _ in range(30_000)), " " * 50_000, "\n \n" * 20_000):
        assert ids_of(text) == library.encode_ordinary(text)
    assert len(ids_of("".join(rng.choice("abcdefgh") for _ in range(1_000_000)))) > 1000


def test_a_lower_rank_that_appears_late_goes_first(tmp_path):
    """The pair of the token "ab" and "c" ranks below "ab" itself."""
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"xab"]
    path = tmp_path / "ranks.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % k for k, t in enumerate(tokens)))
    own = tiktoken.Encoding("x", pat_str=r"\S+|\s+", mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    words = rank_queue.Words(rank_queue.Ranks(str(path), r"\S+|\s+"))
    for text in ("xabc ab abab", "xxabcabc", "abcxab", "cab" * 9):
        assert np.frombuffer(rank_queue.encode_texts([text], words)[0], "<u4").tolist() == own.encode_ordinary(text)


def test_byte_bpe_round_trip_on_awkward_rows(spark, library):
    texts = [None, "", " ", "one", "x" * 5000, "é😀 中文", "don't\r\n\r\n  stop"] + ["one"]
    rows = [(k, t, "r", 1, [3]) for k, t in enumerate(texts)] + [(None, "no id", "r", 2, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, decoded string, n_tokens int, ids array<int>").repartition(3)
    encoded = rank_queue.encode(docs, VOCABULARY)
    found = {r["doc_id"]: r for r in rank_queue.decode(encoded.withColumn("copy", F.col("ids")), VOCABULARY).collect()}
    assert len(found) == len(rows)
    for k, text, *_ in rows:
        assert list(found[k]["copy"]) == library.encode_ordinary(text or "")
        assert bytes(found[k]["decoded"]) == (text or "").encode() and found[k]["n_tokens"] == len(found[k]["copy"])
    empty = rank_queue.decode(rank_queue.encode(docs.limit(0), VOCABULARY), VOCABULARY)
    assert empty.columns == ["doc_id", "n_tokens", "decoded"] and empty.count() == 0
    foreign = spark.createDataFrame([(1, [104, None, -5, 10**6, 105]), (2, None)], "k int, ids array<int>")
    tokens = rank_queue.load(VOCABULARY).ranks.tokens
    assert {r["k"]: bytes(r["decoded"]) for r in rank_queue.decode(foreign, VOCABULARY).collect()} == {1: tokens[104] + tokens[105], 2: b""}


def test_op13_equals_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.op13_byte_bpe_round_trip(spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(texts[r["doc_id"]])


# ---------------------------------------------------------------- periodic runs


def plain_runs(w, least=12):
    """Every lag, every stretch, every shorter period."""
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            stretch = w[i : j + q]
            size = len(stretch)
            if j > i and size >= max(least, 2 * q):
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    found.append((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def words_with_runs(rng, kind):
    n = rng.randrange(140)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        return [rng.randrange(1, 3) if rng.random() < 0.1 else 0 for _ in range(n)]
    if kind == 2:
        root = [rng.randrange(3) for _ in range(rng.randrange(1, 30))]
        words = (root * 140)[:n]
        for _ in range(min(n, rng.randrange(3))):
            words[rng.randrange(n)] = 9
        return words
    if kind == 3:
        words = []
        while len(words) < n:
            root = [rng.randrange(30) for _ in range(rng.randrange(1, 25))]
            words += (root * 5)[: int(len(root) * rng.uniform(1, 4))]
        return words
    if kind == 4:  # runs that overlap on many levels
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    root = [0] * rng.randrange(1, 30) + [1]
    return (root * 6)[rng.randrange(5) :][:n] + [2] + [0] * rng.randrange(20)


@pytest.mark.parametrize("kind", range(6))
def test_runs_equal_the_plain_search(kind):
    rng, total = random.Random(kind), 0
    for _ in range(400):
        words = words_with_runs(rng, kind)
        wanted = plain_runs(words)
        assert periodic_runs.runs_of(np.array(words, np.int64)) == wanted, words
        total += len(wanted)
    assert total > 100


def test_splitting_leaves_words_that_recur():
    rng = random.Random(5)
    for _ in range(300):
        words = [rng.randrange(12) for _ in range(rng.randrange(60))] + list(range(50, 50 + rng.randrange(3)))
        rng.shuffle(words)
        segments = periodic_runs.segments(np.array(words, np.int64), 4)
        for low, high in segments:
            assert high - low >= 4 and all(words[low:high].count(w) > 1 for w in words[low:high])
        for start, length, _ in plain_runs(words, 4):
            assert any(low <= start and start + length <= high for low, high in segments)


def test_long_texts_take_no_quadratic_time():
    import time

    start = time.monotonic()
    shapes = [[0] * 200_000, ([0] * 200 + [1]) * 600, [x for i in range(100_000) for x in (i + 1, i)], list(range(50_000)) * 4]
    sizes = [len(periodic_runs.runs_of(np.array(w, np.int64))) for w in shapes]
    assert sizes == [1, 601, 0, 1] and time.monotonic() - start < 60


def run_row(doc_id, text, plant=True):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words) if n >= 12 else []
    dropped = {i for start, length, period in runs for i in range(start + period, start + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return len(runs), *head, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in dropped))


RUN_COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_op11_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r["text"] or "") < 6_000}
    found = [r for r in queries.op11_periodic_runs(spark, SF).collect() if r["doc_id"] in texts]
    assert len(found) == len(texts) and sum(r["n_runs"] > 0 for r in found) > len(texts) // 20
    for r in found:
        assert tuple(r[c] for c in RUN_COLUMNS) == run_row(r["doc_id"], texts[r["doc_id"]]), r["doc_id"]


def test_runs_on_awkward_rows(spark):
    texts = [None, "", " \t\n\x0b\f\r ", "one", "a " * 11, "a " * 12, "a b " * 6, "x a b c a b c a b c a b c y", "\x1c \x85 é " * 9]
    texts += ["a b c d e f g h " * 3 + "z " + "q " * 13 + "q", "a b\na b\n" * 40]
    rows = [(k, t, "r", 5) for k, t in enumerate(texts)] + [(3, "one", "r", 5), (None, "p q " * 9, "r", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, n_words int").repartition(3)
    plain = periodic_runs.digests(periodic_runs.find(docs)).collect()
    assert sorted((repr(r["doc_id"]), *(r[c] for c in RUN_COLUMNS)) for r in plain) == sorted(
        (repr(i), *run_row(i, t, plant=False)) for i, t, *_ in rows
    )
    planted = periodic_runs.digests(periodic_runs.find(queries.with_planted_repetitions(docs.select("doc_id", "text"))))
    assert sorted((repr(r["doc_id"]), *(r[c] for c in RUN_COLUMNS)) for r in planted.collect()) == sorted(
        (repr(i), *run_row(i, t)) for i, t, *_ in rows
    )
    assert periodic_runs.digests(periodic_runs.find(docs.limit(0))).count() == 0
    text = periodic_runs.find(docs, keep=("doc_id", "text")).filter("doc_id = 7").first()
    assert text["collapsed"] == "x a b c y" and [tuple(r) for r in text["runs"]] == [(1, 12, 3)]


# ---------------------------------------------------------------- whitening


def matrices():
    rng = np.random.default_rng(1)
    for k in range(180):
        d, n = int(rng.integers(1, 50)), int(rng.integers(1, 200))
        x = rng.normal(size=(n, d))
        if k % 6 == 1:
            x = x * 10.0 ** rng.uniform(-6, 3, size=d)
        if k % 6 == 2 and d > 3:
            x[:, 1], x[:, 2] = x[:, 0], 0
        if k % 6 == 3:
            x = x[:, :1] @ rng.normal(size=(1, d))
        if k % 6 == 4:
            x = np.round(x)
        if k % 6 == 5:
            x = np.eye(d)[np.arange(n) % d]
        yield x


def test_solver_equals_numpy():
    for x in matrices():
        n, d = x.shape
        r = whitening._fold([x[i : i + 37] for i in range(0, n, 37)], d)
        a, b, right = whitening.bidiagonal(r)
        assert np.abs(right.T @ right - np.eye(d)).max() < 1e-13
        wanted = np.concatenate([np.linalg.svd(x, compute_uv=False), np.zeros(d)])[:d]
        assert np.abs(np.sqrt(np.maximum(whitening.squared_singular_values(a, b), 0)) - wanted).max() <= 1e-13 * max(wanted[0], 1e-300) * d
        values, directions, trace = whitening.solve(r, n, 8)
        some = [k for k, v in enumerate(values) if v > 0]
        v = np.array(directions)[some]
        assert np.abs(v @ v.T - np.eye(len(some))).max(initial=0) < 1e-11
        assert np.abs(x.T @ (x @ v.T) / n - v.T * np.array(values)[some]).max(initial=0) < 1e-11 * max(values[0], 1e-300)
        assert trace == pytest.approx((x * x).sum() / n)


def test_small_values_are_relatively_accurate():
    """A graded bidiagonal matrix, whose least value no backward stable method on its square could see."""
    a, b = np.array([1e10, 1e5, 1.0, 1e-5, 1e-10]), np.array([1e8, 1e3, 1e-2, 1e-7])
    found = np.sqrt(whitening.squared_singular_values(a, b))
    assert np.prod(found) == pytest.approx(np.prod(a), rel=1e-12)  # the determinant
    assert found[-1] == pytest.approx(1e-10, rel=1e-3)


def whitened_by_hand(vectors):
    x = np.floor(1024 * np.array(vectors, np.float64)) + 100_000
    n = len(x)
    centred = x - x.sum(axis=0) / n
    values, v = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:8]
    moved = [[int(n * c - s) for c, s in zip(row, x.sum(axis=0))] for row in x]
    return n, [sum(c * c for c in row) for row in moved], centred @ v[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_op12_equals_numpy(spark):
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect())
    n, deviation, wanted, explained = whitened_by_hand([r["embedding"] for r in rows])
    found = sorted(queries.op12_embedding_whitening(spark, SF).collect(), key=lambda r: (r["vec_id"], r["component"]))
    assert len(found) == 8 * n and {r["component"] for r in found} == set(range(1, 9))
    got = np.array([r["whitened"] for r in found]).reshape(n, 8)
    signs = np.sign((got * wanted).sum(axis=0))
    assert np.abs(got * signs - wanted).max() < 1e-8
    assert [r["deviation"] for r in found[::8]] == deviation and {r["n"] for r in found} == {n}
    assert [r["explained"] for r in found[:8]] == pytest.approx(list(explained), rel=1e-10)
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9


def vectors_of(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, component int, part int, x string").repartition(3)
    return whitening.grid(df.drop("x"), "embedding", 1024, 100_000)


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(2)
    inf, nan = float("inf"), float("nan")
    good = [[float(v) for v in np.float32(rng.normal(size=5))] for _ in range(60)] + [[0.5] * 5] * 3
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0], [nan] + [0.0] * 4, [inf] + [0.0] * 4, [-inf] * 5]
    rows = [(k, v, 7, 8, "c") for k, v in enumerate(good + bad)] + [(None, good[0], None, None, None)]
    vectors = vectors_of(spark, rows)
    model = whitening.fit(vectors)
    found = whitening.whiten(vectors, model, ("vec_id",)).collect()
    n, deviation, wanted, explained = whitened_by_hand(good + [good[0]])
    assert len(found) == 5 * n and model.n == n
    by_key = {(r["vec_id"], r["component"]): r for r in found}
    for c in range(5):
        got = np.array([by_key[k, c + 1]["whitened"] for k in range(len(good))])
        sign = np.sign((got * wanted[:-1, c]).sum())
        assert np.abs(got * sign - wanted[:-1, c]).max() < 1e-8
        assert by_key[None, c + 1]["whitened"] == by_key[0, c + 1]["whitened"]
        assert by_key[0, c + 1]["explained"] == pytest.approx(explained[c])
    assert [by_key[k, 1]["deviation"] for k in range(len(good))] == deviation[:-1]


def test_whitening_without_variance_rows_or_one_dimension(spark):
    flat = vectors_of(spark, [(k, [1.0, 2.0, float(k % 2)], 0, 0, "") for k in range(10)])
    rows = whitening.whiten(flat, whitening.fit(flat), ("vec_id",)).collect()
    assert len(rows) == 30 and {r["whitened"] is None for r in rows if r["component"] > 1} == {True}
    assert sorted(abs(r["whitened"]) for r in rows if r["component"] == 1) == pytest.approx([1.0] * 10)
    assert {r["explained"] for r in rows} == {1.0, 0.0} and max(r["identity_error"] for r in rows) < 1e-12
    same = vectors_of(spark, [(k, [1.0, 2.0], 0, 0, "") for k in range(4)])
    rows = whitening.whiten(same, whitening.fit(same), ("vec_id",)).collect()
    assert {(r["whitened"], r["deviation"], r["identity_error"]) for r in rows} == {(None, 0, None)} and len(rows) == 8
    empty = vectors_of(spark, [(1, None, 0, 0, "")])
    assert whitening.whiten(empty, whitening.fit(empty), ("vec_id",)).count() == 0
    mixed = vectors_of(spark, [(k, [float(k), float(k * k % 7)][: 1 + (k != 3)], 0, 0, "") for k in range(9)])
    rows = whitening.whiten(mixed, whitening.fit(mixed), ("vec_id",)).collect()
    assert {r["vec_id"] for r in rows} == set(range(9)) - {3} and {r["n"] for r in rows} == {8}


def test_deviations_are_exact_or_null_beyond_a_long():
    model = whitening.Whitening(3, [0, 0], [1.0, 1.0], [[1.0, 0.0], [0.0, 1.0]], 2.0)
    big = 1 << 30
    found = whitening._deviations(np.array([[big, big], [1, 2], [big, -3]]), model)
    assert found == [None if 18 * big * big >= 1 << 63 else 18 * big * big, 45, 9 * (big * big + 9) if 9 * (big * big + 9) < 1 << 63 else None]
    assert hashlib.sha256(b"").hexdigest() == sha("")
