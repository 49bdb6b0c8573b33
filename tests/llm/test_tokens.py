import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import ASCII, ODD, empty, frame
from vellumine.llm import lattice_lm
from vellumine.llm.bpe import WordBpe, bpe_digests
from vellumine.llm.packing import Packer, pack_documents
from vellumine.llm.token_store import DacReader, dac_encode, token_store
from vellumine.llm.vocabulary import ByteEncoder, WordEncoder

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
BYTES, WORDS, PIECES = public.path("byte_bpe_50k.json"), public.path("word_bpe_49k.json"), public.path("piece_bpe_32k.model")
TEXT = st.text(st.sampled_from(list("aAbe tT'.,!\n\t  12éÉßΣσ日🙂_-<|>\x1c\x85́᠎")) | st.characters(exclude_categories=["Cs"]), max_size=60)
library = {x: tokenizers.Tokenizer.from_file(x) for x in (BYTES, WORDS)}
encoders = {BYTES: ByteEncoder(BYTES), WORDS: WordEncoder(WORDS)}
own = WordBpe(WORDS)


def ids(path, text):
    return library[path].encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_cached_encoding_is_the_library_s(texts):
    for path, encoder in encoders.items():
        assert encoder.ids(texts) == [np.array(ids(path, x), "<u4").tobytes() for x in texts]


class Watched:
    """The library's tokenizer, which notes the texts it gets."""

    def __init__(self, tokenizer):
        self.tokenizer, self.seen = tokenizer, []

    def encode_batch_fast(self, texts, **given):
        self.seen += texts
        return self.tokenizer.encode_batch_fast(texts, **given)


@pytest.mark.parametrize(("kind", "path"), [(ByteEncoder, BYTES), (WordEncoder, WORDS)])
def test_letters_and_marks_need_no_pattern(kind, path):
    """Words, also with runs of marks behind them, go to the model without the library's other rules."""
    text = ". one Naïve straße two!!! QX$$$ École,*** end. again.%%% again"
    encoder = kind(path)
    encoder.library = Watched(encoder.library)
    assert encoder.ids([text]) == [np.array(ids(path, text), "<u4").tobytes()]
    assert not [x for x in encoder.library.seen if any(map(str.isalpha, x))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.builds(str.__add__, st.text("abeESÉßz", min_size=1, max_size=5), st.text(".,;:!?$%&*#@+=-/()[]{}\"'<|_1", max_size=4)), max_size=12))
def test_marks_behind_words(words):
    for path, encoder in encoders.items():
        for text in (" ".join(words), "\n".join(words)):
            assert encoder.ids([text]) == [np.array(ids(path, text), "<u4").tobytes()]


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_rank_arrays_encode_and_decode_as_the_library(text):
    assert own.encode(text) == ids(WORDS, text)
    assert own.decode(own.encode(text)) == library[WORDS].decode(ids(WORDS, text), skip_special_tokens=False)


def test_long_words():
    for text in ("ab" * 2000, "x" * 3001, "thequickbrownfox" * 40, "<|endoftext|>" * 3, "don't'll"):
        assert own.encode(text) == ids(WORDS, text)


def test_bpe_digests(spark):
    found = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_digests(frame(spark), WORDS).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(str(i), len(k := ids(WORDS, t or "")), sha(" ".join(map(str, k))), sha(library[WORDS].decode(k, skip_special_tokens=False))) for i, t in ODD]
    assert found == sorted(want)
    assert bpe_digests(empty(spark), WORDS).count() == 0


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_directly_addressable_codes(values):
    reader = DacReader(dac_encode(np.array(values, np.uint32)))
    assert reader.all().tolist() == values and len(reader) == len(values)
    for i in {0, len(values) // 2, len(values) - 1} if values else ():
        assert reader[i] == values[i]
    with pytest.raises(IndexError):
        reader[len(values)]


def test_token_store(spark):
    found = token_store(frame(spark), BYTES).collect()
    each = {(i, t): np.array([*ids(BYTES, t or ""), 2], "<u4") for i, t in ODD}
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in found) == sorted((str(i), len(each[i, t]), zlib.crc32(each[i, t])) for i, t in ODD)
    rows = sorted(found, key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()
    assert [r.doc_id for r in rows] == sorted((i for i, _ in ODD), key=lambda x: (x is not None, x))
    assert token_store(empty(spark), BYTES).count() == 0


def check_packed(rows, want):
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    for own_rows in windows.values():
        own_rows.sort(key=lambda r: r.offset)
        total = sum(r.length for r in own_rows)
        assert [r.offset for r in own_rows] == np.cumsum([0, *(r.length for r in own_rows[:-1])]).tolist()
        assert total == own_rows[0].window <= 4096 and len({r.step_group for r in own_rows}) == 1
    assert sum(r.length for r in rows) == sum(map(len, want))
    return windows


def test_packing(spark):
    rows = pack_documents(frame(spark), WORDS).collect()
    each = [(i, np.array([*ids(WORDS, t or ""), 2], "<u4")) for i, t in ODD]
    check_packed(rows, [x for _, x in each])
    by = {i: x for i, x in each if i not in (6, None)}
    for r in rows:
        if r.doc_id in by:
            assert zlib.crc32(by[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 and r.doc_tokens == len(by[r.doc_id])
    assert pack_documents(empty(spark), WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60))
def test_packer_places_every_id_once(lengths):
    packer = Packer((512, 1024, 2048, 4096))
    for i, n in enumerate(lengths):
        packer.add((i,), bytes(4 * n))
    packer.finish()
    placed = Counter()
    for size, pieces in packer.done:
        assert sum(p.length for p in pieces) == size and size & (size - 1) == 0
        for p in pieces:
            placed.update((p.row[0], k) for k in range(p.start, p.start + p.length))
    assert placed == {(i, k): 1 for i, n in enumerate(lengths) for k in range(n)}


def test_lattice_sums_all_segmentations():
    names = lattice_lm.piece_names(PIECES)
    logs = np.log(np.random.default_rng(0).random(len(names)) / 1000)
    lattice, weight = lattice_lm.Lattice(names, logs, -1.0), dict(zip(names, logs, strict=True))

    def brute(text):
        total = -np.inf if text else 0.0
        for k in range(1, min(len(text), lattice.longest) + 1):
            head = text[:k]
            if head in weight and not (head.startswith("<") and head.endswith(">") and len(head) > 2):
                total = np.logaddexp(total, weight[head] + brute(text[k:]))
            elif k == 1:
                total = np.logaddexp(total, sum(weight[f"<0x{b:02X}>"] for b in head.encode()) + brute(text[1:]))
        return total

    for word in ("the", "cat", "日本", "", "<s>", "🙂a", "hello"):
        assert math.isclose(brute("▁" + word) / math.log(10), lattice.words([word.encode()])[0], abs_tol=1e-9)
    assert np.isfinite(lattice.words([b"x" * 3000, b"\xff"])).all()


def segmentations(text, weight):
    """Every way to cut a text into pieces, each with its log probability."""
    if not text:
        return [((), 0.0)]
    out = []
    for k in range(1, len(text) + 1):
        head = text[:k]
        if head in weight and not (head.startswith("<") and head.endswith(">") and k > 2):
            own = (head,)
        elif k == 1:
            own = tuple(f"<0x{b:02X}>" for b in head.encode())
        else:
            continue
        out += [((*own, *rest), sum(weight[x] for x in own) + log) for rest, log in segmentations(text[k:], weight)]
    return out


def counted(words, weight):
    """Expected pieces of so many of each word, by enumeration."""
    total = Counter()
    for word, times in words.items():
        ways = segmentations("▁" + word, weight)
        whole = np.logaddexp.reduce([x for _, x in ways])
        for pieces, log in ways:
            for x in pieces:
                total[x] += times * math.exp(log - whole)
    return total


def test_expected_pieces_are_those_of_all_segmentations(monkeypatch):
    names = lattice_lm.piece_names(PIECES)
    logs = np.log(np.random.default_rng(1).random(len(names)) / 1000)
    lattice, words = lattice_lm.Lattice(names, logs, -1.0), {"the": 3, "cats": 2, "日本": 1, "🙂a": 5, "hello": 1, "then": 4}
    want = counted(words, dict(zip(names, logs, strict=True)))
    for long in (256, 2):
        monkeypatch.setattr(lattice_lm, "LONG", long)
        found = lattice.expected([x.encode() for x in words], np.array(list(words.values())))
        assert all(math.isclose(found[i], want.get(x, 0.0), rel_tol=1e-9, abs_tol=1e-12) for i, x in enumerate(names))


def test_long_words_are_summed_as_short_ones(monkeypatch):
    names = lattice_lm.piece_names(PIECES)
    lattice = lattice_lm.Lattice(names, np.log(lattice_lm.prior_counts(PIECES) + 1e-9) - 7, -1.0)
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("theandofis日é🙂"), 250)).encode(), b"ab" * 120, b"x" * 200]
    marginals, pieces = lattice.words(words), lattice.expected(words, np.array([1, 2, 3]))
    for positions in (1 << 14, 17):
        monkeypatch.setattr(lattice_lm, "LONG", 10)
        monkeypatch.setattr(lattice_lm, "POSITIONS", positions)
        assert np.allclose(lattice.words(words), marginals, rtol=1e-10) and np.allclose(lattice.expected(words, np.array([1, 2, 3])), pieces, rtol=1e-7, atol=1e-9)
    assert np.isfinite(lattice.words([b"thequick" * 20_000])).all()


def test_prior_follows_the_scores():
    prior, names = lattice_lm.prior_counts(PIECES), lattice_lm.piece_names(PIECES)
    by = dict(zip(names, prior, strict=True))
    assert math.isclose(prior.sum(), lattice_lm.PRIOR) and by["<unk>"] == by["</s>"] == 0
    model = lattice_lm.library(PIECES)
    ranks = [-model.get_score(model.piece_to_id(x)) for x in ("om", "▁Device")]
    assert math.isclose(by["om"] / by["▁Device"], (ranks[1] + lattice_lm.RANK_OFFSET) / (ranks[0] + lattice_lm.RANK_OFFSET)) and by["<0x41>"] <= min(by["om"], by["▁Device"])


def test_scores_are_those_of_a_plain_recomputation(spark):
    rows = [(i, t) for i, t in enumerate(("the cat sat", "a cat and the dog", "The Cat", "", "dog dog é", "sat on a mat", "one cat", "so it is", "日本 cat"))]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    words = [t.translate(ASCII).split() for _, t in rows]
    counts, texts = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws), held.count(False)
    names, prior, model = lattice_lm.piece_names(PIECES), lattice_lm.prior_counts(PIECES), lattice_lm.library(PIECES)

    def weights(found):
        own = {x: found.get(x, 0.0) + p for x, p in zip(names, prior, strict=True)}
        whole = sum(v for x, v in own.items() if x not in ("<unk>", "<s>", "</s>")) + texts + lattice_lm.END_PRIOR
        return {x: math.log(v / whole) if v else -math.inf for x, v in own.items()}, math.log((texts + lattice_lm.END_PRIOR) / whole)

    first = Counter()
    for w, c in counts.items():
        for piece in model.encode(w, out_type=str):
            first[piece] += c
    logs, end = weights(first)
    for _ in range(lattice_lm.ROUNDS):
        logs, end = weights(counted(counts, logs))
    want = {i: (sum(np.logaddexp.reduce([x for _, x in segmentations("▁" + w, logs)]) for w in ws) + end) / math.log(10) for (i, _), ws in zip(rows, words, strict=True)}
    found = {r.doc_id: r.score for r in lattice_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), PIECES).collect()}
    assert any(held) and all(math.isclose(found[i], want[i], rel_tol=1e-9) for i in want)


@pytest.mark.parametrize("frequent", [250_000, 3, 0])
def test_lattice_scores(spark, monkeypatch, frequent):
    monkeypatch.setattr(lattice_lm, "FREQUENT", frequent)
    rows = [(i, t) for i, t in ODD if i not in (8, 9)] + [(i, f"word{i % 7} Other word{i % 3} the") for i in range(100, 140)]
    found = lattice_lm.score_texts(frame(spark, rows), PIECES).collect()
    split = {k: [w for w in (t or "").translate(ASCII).encode().split()] for k, (_, t) in enumerate(rows)}
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(w for k, ws in split.items() if not held[k] for w in ws)
    texts = held.count(False)
    n, v = sum(counts.values()) + texts, len(counts) + 1
    base = lambda ws: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) + math.log10((texts + 1) / (n + v + 1))
    want = sorted((str(i), held[k], len(split[k]) + 1, sum(counts[w] > 0 for w in split[k]) + 1, n, round(base(split[k]), 6)) for k, (i, _) in enumerate(rows))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    assert lattice_lm.score_texts(empty(spark), PIECES).count() == 0
    only = lattice_lm.score_texts(spark.createDataFrame([(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2), "held out")], "doc_id long, text string"), PIECES).first()
    assert only.train_tokens == 0 and only.n_known == 0 and math.isfinite(only.score)
