"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Distinct words of equal length advance together, character by character. At each position the hashes of the
substrings that end there probe the sorted piece keys; of the pieces found, the best one is kept with a
backpointer. The installed model is a BPE model, where the sum of piece scores doesn't give the model's own
segmentation; the score of a step is therefore whether the piece can follow the one before it, that is, whether
the model's merges would leave this pair apart. Exactly one piece per position can, so the maximum is the
model's own encoding, token by token.

White space splits words: no piece of the model holds it after another character (checked when the tables are
built). So do punctuation marks that no piece holds after a letter or digit. A character that no piece holds
becomes its UTF-8 bytes. The rare word of over LONG_WORD characters is merged pair by pair from a queue instead, in time
that grows with its length and not with numpy calls for every character; the result is the same.

Defined results: a null or empty text has no tokens and decodes to ''; the model writes U+2581 for a space, so
that character decodes to a space; repeated rows and null ids are encoded each on its own; an empty table gives
an empty result; other columns are carried along by add_tokens and not returned by encode.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lucerna.llm.common import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: A memo of encoded words per task is emptied beyond so many words.
MEMO_WORDS = 100_000
#: Characters above which a word's merges are made one after the other.
LONG_WORD = 256
TOKENS = "token_ids array<int>, n_tokens long, n_byte_tokens long, decoded_ok boolean"

_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Tables:
    """Fixed-size arrays of one model. Pieces are numbered with single characters first, then by merge rank."""

    ids: np.ndarray  # model id of each piece
    lengths: np.ndarray  # characters of each piece; the last entry stands for an unknown character
    keys: np.ndarray  # sorted hashes of the pieces
    at: np.ndarray  # piece of each hash
    left: np.ndarray  # the two pieces whose merge makes a piece; itself for a single character
    right: np.ndarray
    pairs: np.ndarray  # sorted (left << 32 | right) of all pairs that can merge
    merged: np.ndarray  # the piece of each pair
    runs: dict[int, int]  # model id of each white-space run
    byte_ids: list[int]
    text: list[bytes]  # UTF-8 of each model id, U+2581 as a space
    units: str  # pattern of what can be encoded by itself
    maybe: np.ndarray  # whether a hash's first bits occur among keys
    joins: dict[int, int] | None = None  # merged by pair, made where it is first needed


def _hash(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        h = h * _BASE + codes[:, k].astype(np.uint64) + np.uint64(1)
    return h


def _last_merge(piece: str, rank: dict[str, int]) -> tuple[str, str] | None:
    """The two parts of the last merge with which the model builds piece from its characters; None if it doesn't."""
    parts = list(piece)
    while len(parts) > 2:
        ranks = [rank.get(a + b, len(rank)) for a, b in zip(parts, parts[1:])]
        k = int(np.argmin(ranks)) if len(ranks) > 8 else ranks.index(min(ranks))
        if ranks[k] == len(rank):
            return None
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def _units(pieces: list[str]) -> str:
    """Pattern of the units: white space, marks and other characters, cut where no piece spans the cut."""
    before: dict[str, set[str]] = {}
    for p in pieces:
        for a, b in zip(p, p[1:]):
            before.setdefault(b, set()).add(a)
    marks = {c for p in pieces for c in p if not (c.isalpha() or c.isdecimal()) and c != SPACE}
    while odd := {c for c in marks if before.get(c, set()) - marks - {SPACE}}:
        marks -= odd
    m = "".join(map(re.escape, sorted(marks)))
    rest = f"[^{SPACE}\n{m}]"
    return f"{SPACE}+" + (f"[{m}]*{rest}*|[{m}]+{rest}*" if marks else f"{rest}*") + f"|{rest}+|\n"


def run_of_spaces(n: int, runs: dict[int, int]) -> list[int]:
    """Lengths of the pieces of n spaces: the leftmost pair that makes a piece is merged first."""
    done: list[int] = []
    for _ in range(n):
        done.append(1)
        while len(done) > 1 and done[-2] + done[-1] in runs and (len(done) < 3 or done[-3] + done[-2] not in runs):
            done[-2:] = [done[-2] + done[-1]]
    return done


def load(model: str = MODEL) -> Tables:
    """Reads the model on the driver; the tables grow with the model's vocabulary only."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    size = sp.get_piece_size()
    byte_ids, text, runs, normal = [0] * 256, [b""] * size, {}, {}
    for i in range(size):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[1:-1], 16)], text[i] = i, bytes([int(piece[1:-1], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i)):
            text[i] = piece.replace(SPACE, " ").encode()
            if set(piece) == {SPACE}:
                runs[len(piece)] = i
            if len(piece) == 1 or set(piece) != {SPACE}:
                normal[piece] = i
                if SPACE in piece[1:]:
                    raise ValueError(f"piece {piece!r} holds white space inside; words can't be encoded one by one")
    merges = sorted((p for p in normal if len(p) > 1), key=lambda p: -sp.get_score(normal[p]))
    rank = {p: k for k, p in enumerate(merges)}
    split = {p: _last_merge(p, rank) for p in merges}
    order = [p for p in normal if len(p) == 1] + [p for p in merges if split[p]]
    number = {p: k for k, p in enumerate(order)}
    n = len(order)
    left, right = np.arange(n + 1), np.arange(n + 1)
    pairs = {}
    for p in order:
        if len(p) > 1:
            left[number[p]], right[number[p]] = number[split[p][0]], number[split[p][1]]
            for k in range(1, len(p)):
                if p[:k] in number and p[k:] in number:
                    pairs[number[p[:k]] << 32 | number[p[k:]]] = number[p]
    keys = np.zeros(n, np.uint64)
    lengths = np.array([*map(len, order), 1])
    for size_ in set(lengths.tolist()):
        rows = np.flatnonzero(lengths[:-1] == size_)
        joined = "".join(order[r] for r in rows).encode("utf-32-le")
        keys[rows] = _hash(np.frombuffer(joined, np.uint32).reshape(len(rows), size_))
    at = np.argsort(keys)
    if len(np.unique(keys)) != n:
        raise ValueError("two pieces share a hash")
    maybe = np.zeros(1 << 20, bool)
    maybe[keys >> np.uint64(44)] = True
    packed = np.array(sorted(pairs.items()), np.int64).reshape(-1, 2)
    return Tables(np.array([normal[p] for p in order] + [-1]), lengths, keys[at], at, left, right, packed[:, 0].copy(), packed[:, 1].copy(), runs, byte_ids, text, _units(order), maybe)


def apart(t: Tables, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the merges leave piece b standing after piece a.

    Undoes, newest first, the merges that made a and b, and looks at each point for a merge across the border
    that would have come before those still undone.
    """
    ok = np.ones(len(a), bool)
    live = np.arange(len(a))
    a, b = a.copy(), b.copy()
    limit = np.full(len(a), np.iinfo(np.int64).max)
    while len(live):
        key = (a << 32) | b
        k = np.minimum(np.searchsorted(t.pairs, key), len(t.pairs) - 1)
        bad = (t.pairs[k] == key) & (t.merged[k] < limit)
        ok[live[bad]] = False
        go = ~bad
        live, a, b = live[go], a[go], b[go]
        down_a, down_b = t.right[a], t.left[b]
        whole_a, whole_b = down_a == a, down_b == b
        first = ((a > b) & ~whole_a) | whole_b
        limit = np.where(first, a, b + 1)
        go = ~(whole_a & whole_b)
        a, b = np.where(first, down_a, a), np.where(first, b, down_b)
        live, a, b, limit = live[go], a[go], b[go], limit[go]
    return ok


def viterbi(t: Tables, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """codes: (words, length) code points. Pieces of all words in order, and how many each word has."""
    n, length = codes.shape
    longest = int(t.lengths.max())
    unknown = len(t.lengths) - 1
    prefix = np.zeros((length + 1, n), np.uint64)
    power = [np.uint64(1)]
    for k in range(length):
        prefix[k + 1] = prefix[k] * _BASE + codes[:, k].astype(np.uint64) + np.uint64(1)
        power.append(np.uint64((int(power[-1]) * int(_BASE)) % 2**64))
    best = np.full((length + 1, n), -1, np.int64)
    for end in range(1, length + 1):
        words, cands = [], []
        for size in range(1, min(end, longest) + 1):
            h = prefix[end] - prefix[end - size] * power[size]
            probe = np.flatnonzero(t.maybe[h >> np.uint64(44)])
            h = h[probe]
            k = np.minimum(np.searchsorted(t.keys, h), len(t.keys) - 1)
            piece = np.full(n, -1, np.int64)
            piece[probe] = np.where((t.keys[k] == h) & (t.lengths[t.at[k]] == size), t.at[k], -1)
            if size == 1:
                piece[piece < 0] = unknown
            found = np.flatnonzero(piece >= 0)
            words.append(found)
            cands.append(piece[found])
        word, cand = np.concatenate(words), np.concatenate(cands)
        start = end - t.lengths[cand]
        before = best[start, word]
        fits = (start == 0) | (before >= 0)
        check = np.flatnonzero(fits & (start > 0))
        fits[check] = apart(t, before[check], cand[check])
        best[end, word[fits]] = cand[fits]  # one piece a word fits: the maximum
    back = np.full((n, length), -1, np.int64)
    at = np.full(n, length)
    rows = np.arange(n)
    while len(rows):
        piece = best[at[rows], rows]
        at[rows] -= t.lengths[piece]
        back[rows, at[rows]] = piece
        rows = rows[at[rows] > 0]
    there = back >= 0
    return back[there], there.sum(1)


def merge_pieces(t: Tables, codes: np.ndarray) -> np.ndarray:
    """The pieces of one very long word, by the model's merges in the order of their rank, the leftmost first.

    What viterbi() gives, too; it takes numpy steps for each character of a word, which pay where many words share them.
    """
    joins = t.joins if t.joins is not None else dict(zip(t.pairs.tolist(), t.merged.tolist()))
    t.joins = joins
    n = len(codes)
    h = codes.astype(np.uint64) + np.uint64(1)
    k = np.minimum(np.searchsorted(t.keys, h), len(t.keys) - 1)
    unknown = len(t.lengths) - 1
    piece = np.where((t.keys[k] == h) & (t.lengths[t.at[k]] == 1), t.at[k], unknown).tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(m, i, piece[i], piece[i + 1]) for i in range(n - 1) if (m := joins.get(piece[i] << 32 | piece[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        m, i, a, b = heapq.heappop(heap)
        j = after[i]
        if piece[i] != a or j >= n or piece[j] != b:
            continue  # one of the two has been merged already
        piece[i], piece[j] = m, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (made := joins.get(piece[x] << 32 | piece[y])) is not None:
                heapq.heappush(heap, (made, x, piece[x], piece[y]))
    return np.array([q for q in piece if q >= 0])


def encode_words(t: Tables, words: list[str], memo: dict[str, bytes]) -> None:
    """Adds to memo the model ids, as int32 bytes, of words that hold no white space but at their start."""
    plain, runs = set(), []
    for w in words:
        body = w.lstrip(SPACE)
        if len(w) - len(body) > 1 or not body:
            runs.append((w, body))
            if body and SPACE + body not in memo:
                plain.add(SPACE + body)
        else:
            plain.add(w)
    by_length: dict[int, list[str]] = {}
    for w in plain:
        by_length.setdefault(len(w), []).append(w)
    for length, all_of in by_length.items():
        step = max(1, 400_000 // length)
        for k in range(0, len(all_of), step):
            group = all_of[k : k + step]
            codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(group), length)
            if length <= LONG_WORD:
                flat, counts = viterbi(t, codes)
            else:
                each = [merge_pieces(t, c) for c in codes]
                flat, counts = np.concatenate(each), np.array([len(e) for e in each])
            ids = t.ids[flat].astype(np.int32)
            ends = np.cumsum(counts)
            data = ids.tobytes()
            unknown = np.zeros(len(group), bool)
            unknown[np.repeat(np.arange(len(group)), counts)[ids < 0]] = True
            for w, a, b, odd in zip(group, ((ends - counts) * 4).tolist(), (ends * 4).tolist(), unknown.tolist()):
                memo[w] = data[a:b] if not odd else _with_bytes(t, w, flat[a // 4 : b // 4])
    single = np.int32(t.runs[1]).tobytes()
    for w, body in runs:
        spaces, rest = len(w) - len(body), b""
        if body:
            rest = memo[SPACE + body]
            rest, spaces = (rest[4:], spaces) if rest[:4] == single else (rest, spaces - 1)
        memo[w] = np.array([t.runs[k] for k in run_of_spaces(spaces, t.runs)], np.int32).tobytes() + rest


def _with_bytes(t: Tables, word: str, pieces: np.ndarray) -> bytes:
    out, at = [], 0
    for p in pieces:
        out += [int(t.ids[p])] if t.ids[p] >= 0 else [t.byte_ids[x] for x in word[at].encode("utf-8", "surrogatepass")]
        at += int(t.lengths[p])
    return np.array(out, np.int32).tobytes()


def encode_texts(t: Tables, texts: list[str | None], memo: dict[str, bytes], memo_words: int = MEMO_WORDS) -> list[bytes]:
    pattern = re.compile(t.units)
    units = [pattern.findall(SPACE + x.replace(" ", SPACE)) if x else [] for x in texts]
    fresh = set().union(*units) - memo.keys()
    if len(memo) + len(fresh) > memo_words:
        memo.clear()
        fresh = set().union(*units)
    encode_words(t, list(fresh), memo)
    return [b"".join(map(memo.__getitem__, u)) for u in units]


def decode_ids(t: Tables, ids: np.ndarray) -> bytes:
    """UTF-8 of the text; the space that encoding puts in front is taken off, if there is one: ids may start within a text."""
    found = b"".join(map(t.text.__getitem__, ids.tolist()))
    return found[1:] if found[:1] == b" " else found


def _columns(t: Tables, texts: list[str | None], memo: dict[str, bytes], memo_words: int = MEMO_WORDS) -> list[pa.Array]:
    parts = encode_texts(t, texts, memo, memo_words)
    counts = np.array([len(p) // 4 for p in parts], np.int64)
    flat = np.frombuffer(b"".join(parts), np.int32)
    is_byte = np.zeros(len(t.text), np.int64)
    is_byte[t.byte_ids] = 1
    ends = np.cumsum(counts)
    running = np.concatenate([[0], np.cumsum(is_byte[flat])])
    right = [decode_ids(t, flat[b - n : b]) == (x or "").replace(SPACE, " ").encode("utf-8", "surrogatepass") for x, n, b in zip(texts, counts, ends)]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
    return [lists, pa.array(counts), pa.array(running[ends] - running[ends - counts]), pa.array(right)]


#: Bytes of text encoded together, and words of the memo, where nothing but the tokens is kept of the documents.
ALONE, ALONE_WORDS = 3_000_000, 400_000


def add_tokens(docs: DataFrame, text_col: str = "text", model: str = MODEL, slice_bytes: int | None = None, memo_words: int = MEMO_WORDS) -> DataFrame:
    """docs with the columns of TOKENS (a column of docs with one of these names is replaced). No shuffle.

    slice_bytes: of text that a task encodes together; more share more words and take less time, and more memory. memo_words: the
    same, of the words that it keeps.
    """
    new = ["token_ids", "n_tokens", "n_byte_tokens", "decoded_ok"]
    kept = [c for c in docs.columns if c not in new]
    shared = docs.sparkSession.sparkContext.broadcast(load(model))
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, bytes] = {}
        for batch in slices(batches, text_col, slice_bytes):
            yield pa.RecordBatch.from_arrays([*batch.columns, *_columns(shared.value, batch.column(at).to_pylist(), memo, memo_words)], [*kept, *new])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in kept]).schema)
    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(run, f"{fields}, {TOKENS}")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row per document: its id and the columns of TOKENS."""
    return add_tokens(docs.select(docs[id_col], docs[text_col]), text_col, model, ALONE, ALONE_WORDS).drop(text_col)


def decode(tokens: DataFrame, ids_col: str = "token_ids", model: str = MODEL) -> DataFrame:
    """tokens with a column decoded: the text of its token ids. No ids give ''; null or unknown ids among others stand for nothing."""
    shared = tokens.sparkSession.sparkContext.broadcast(load(model))
    kept = [c for c in tokens.columns if c != "decoded"]
    source = tokens.select(*[f"`{c}`" for c in kept])
    at = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = len(shared.value.text)
            texts = [decode_ids(shared.value, np.array([i for i in x or [] if i is not None and 0 <= i < size], np.int32)).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(run, f"{fields}, decoded string")
