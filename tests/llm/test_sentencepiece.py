import heapq
import random
import time

import numpy as np
import pytest
import sentencepiece

from logloom.llm import sentencepiece_dropout as S
from logloom.llm.common import U64


@pytest.fixture(scope="module")
def model():
    return S.pieces(S.default_model())


def flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


TEXTS = ["Hello world\n new  x\t", "  lead", "é a ü", "", " ", "the anan banana", "日本語 テスト 🙂🙂", "a" * 300, "x▁y ▁", "ohne   Pause\r\n\x00ende ", "thstinnt thndhain onhalyti"]


def test_without_dropout_as_the_library(model):
    lib = sentencepiece.SentencePieceProcessor(model_file=S.default_model())
    rng = random.Random(1)
    texts = [t for t in TEXTS if "▁" not in t] + ["".join(rng.choice("abcdehin rst.,éü\n") for _ in range(rng.randrange(80))) for _ in range(300)]
    ids, per = S.encode(model, *flat(texts), np.zeros(len(texts), U64), dropout=0.0)
    ends = np.cumsum(per)
    for t, e, n in zip(texts, ends, per):
        assert ids[e - n : e].tolist() == lib.encode(t), t


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6, 1.0])
def test_round_trip(model, dropout):
    data, at = flat(TEXTS)
    ids, per = S.encode(model, data, at, np.arange(len(TEXTS)).astype(U64), dropout=dropout)
    back, sizes = S.decode(model, ids, per)
    assert back.tobytes() == data.tobytes() and sizes.tolist() == np.diff(at).tolist()


def agenda(model, chars, key, dropout):
    """One word by the usual agenda: a heap of candidate pairs, each skipped by its hash."""
    sym = [int(model.char[c]) if model.char[c] >= 0 else -1 - c for c in chars]
    left, right = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
    begin, end, alive = list(range(len(sym))), list(range(1, len(sym) + 1)), [True] * len(sym)
    heap = []

    def push(i):
        j = right[i]
        if j < 0:
            return
        m = int(model.merged(np.array([sym[i]]), np.array([sym[j]]))[0])
        if m >= 0:
            heapq.heappush(heap, (int(model.rank[m]), begin[i], i, j, sym[i], sym[j], end[j], m))

    for i in range(len(sym)):
        push(i)
    while heap:
        _, _, i, j, a, b, e, m = heapq.heappop(heap)
        if not alive[i] or not alive[j] or sym[i] != a or sym[j] != b or right[i] != j or end[j] != e:
            continue
        if dropout and S.skipped(np.array([key], U64), np.array([begin[i]]), np.array([end[i]]), np.array([e]), dropout)[0]:
            continue
        sym[i], end[i], alive[j], right[i] = m, e, False, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        push(i)
        if left[i] >= 0:
            push(left[i])
    return [s for s, ok in zip(sym, alive) if ok]


@pytest.mark.parametrize("dropout", [0.0, 0.2, 0.5])
def test_against_agenda(model, dropout):
    rng = random.Random(5)
    words = [[S.MARK, *(ord(rng.choice("aeinrstho日é")) for _ in range(rng.randrange(1, 18)))] for _ in range(300)]
    keys = np.array([rng.randrange(2**63) for _ in words], U64)
    sym, counts, sizes, merges = S.segment(S.Wide(model), np.concatenate([np.array(w) for w in words]), np.array([len(w) for w in words]), keys, dropout)
    ends = np.cumsum(counts)
    for w, k, e, n in zip(words, keys, ends, counts):
        want = agenda(model, w, k, dropout)
        assert sym[e - n : e].tolist() == want == S.segment_long(S.Wide(model), np.array(w), int(k), dropout).tolist()
    assert sizes.sum() == sum(map(len, words)) and len(merges[0]) == sum(map(len, words)) - len(sym)


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6])
def test_occurrences_draw_for_themselves(model, dropout):
    """Shared results are what each occurrence's own agenda gives, and one word gets many segmentations."""
    rng = random.Random(8)
    vocab = [[S.MARK, *(ord(rng.choice("aeinrsthoé")) for _ in range(rng.randrange(1, 14)))] for _ in range(20)]
    words = [rng.choice(vocab) for _ in range(500)] + [[S.MARK, *map(ord, "interesting")]] * 400
    lengths = np.array([len(w) for w in words])
    chars, starts = np.concatenate([np.array(w) for w in words]), np.cumsum(lengths) - lengths
    ids = np.array([hash(tuple(w)) % 2**63 for w in words], U64)
    keys = np.array([rng.randrange(2**63) for _ in words], U64)
    sym, counts = S._occurrences(S.Wide(model), chars, starts, lengths, ids, keys, dropout)
    got, seen = np.split(sym, np.cumsum(counts)[:-1]), set()
    for w, k, g in zip(words, keys, got):
        assert g.tolist() == agenda(model, w, k, dropout)
        seen.add(tuple(g.tolist())) if len(w) == 12 else None
    assert len(seen) > 100 if dropout == 0.6 else len(seen) >= 1


def test_long_tokens(model):
    """A word of a million characters in seconds, equal to the rounds of short words."""
    rng = random.Random(3)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEF0123456789", k=1 << 20))
    data, at = flat([text, "word " + text[:3000]])
    began = time.monotonic()
    ids, per = S.encode(model, data, at, np.array([1, 2], U64))
    assert time.monotonic() - began < 60
    back, sizes = S.decode(model, ids, per)
    assert back.tobytes() == data.tobytes()
    w = np.array([S.MARK, *map(ord, text[:3000])])
    for dropout in (0.0, 0.1):
        assert S.segment_long(S.Wide(model), w, 77, dropout).tolist() == S.segment(S.Wide(model), w, np.array([len(w)]), np.array([77], U64), dropout)[0].tolist()


def test_seed_varies_and_repeats(model):
    data, at = flat(["the quick brown fox jumps over something interesting " * 20])
    key = np.array([9], U64)
    one, again, other = (S.encode(model, data, at, key, seed=s, dropout=0.3)[0].tolist() for s in (1, 1, 2))
    assert one == again != other


def test_documents(spark):
    rows = [(1, "abc def", "n"), (1, "abc def", "n"), (None, "x", None), (4, None, "q"), (5, "", "z"), (6, "long " * 30000, "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_pieces string").withColumnRenamed("n_pieces", "c0").repartition(3)
    got = S.encode_documents(df, dropout=0.4).collect()
    assert len(got) == 6 and set(got[0].asDict()) == {"doc_id", "text", "c0", "n_pieces", "pieces", "round_trip"}
    by = {(r.doc_id, r.text): r for r in got}
    assert by[4, None].pieces is None and by[5, ""].pieces == [] and by[5, ""].round_trip
    assert all(r.round_trip for r in got if r.text is not None)
    taken = S.encode_documents(df.withColumnRenamed("c0", "pieces"), dropout=0.4).collect()
    assert set(taken[0].asDict()) == {"doc_id", "text", "pieces", "n_pieces", "pieces_", "round_trip"} and {r.pieces for r in taken} == {"n", None, "q", "z", "l"}
    same = [r.pieces for r in got if r.doc_id == 1]
    assert same[0] == same[1]
    assert S.encode_documents(df.limit(0)).count() == 0
