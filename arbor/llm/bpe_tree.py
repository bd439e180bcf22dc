"""BPE encoding and decoding by tree concatenation.

A text longer than LEAF characters is cut into leaves; leaves are encoded by different tasks; neighbours are
then joined, two by two, up to the whole text. At a join a window of text around it is encoded again and
grows until it agrees with both sides: on each side, AGREE tokens in a row inside the window (not at its
edge) have the same ids and offsets as the side's own. Tokens left of the left agreement, the window's
tokens between, and tokens right of the right agreement are the tokens of the joined text, as in a BPE
encoding every two neighbours fit each other wherever they stand. A window that reaches both ends is
simply the encoding of the joined text.

White space that the tokenizer drops splits texts exactly, so a leaf is encoded by its words. Words are kept in two memos
of together MEMO_BYTES at most: new words enter the young one, those that come again move to the other, so words
that are met once do not drive out those that are common.

Rules. A null text is empty: no tokens, decoded "". Very long words are cut like any text. Rows keep their
number; repeated rows give repeated results; extra columns are dropped; an empty table gives an empty
result. A document is one row of the input and is put together by one task; only documents longer than LEAF
are shuffled, by id and text hash, so hot sources or copies do not meet in one task.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbor.llm.shared import blocks, cache, release

LEAF = 16384
WINDOW = 64
AGREE = 3
#: Bytes of the memo of words that a Python worker keeps.
MEMO_BYTES = 64 << 20


class Encoder:
    """A tokenizer of the tokenizers library with a memo of words: n ids, then n pairs of starts and ends, 32 bits each."""

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.memo: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.size, self.young_size, self.most = 0, 0, memo_bytes // 2
        size = max(self.tok.get_vocab(with_added_tokens=True).values()) + 1
        self.names = [self.tok.id_to_token(i) or "" for i in range(size)]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Encodes words that the memo lacks, many at a time: joined by blanks they do not touch each other."""
        new = {}
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            e = self.tok.encode(" ".join(part), add_special_tokens=False)
            raw = np.array(e.ids, np.uint32).tobytes()
            off = np.array(e.offsets, np.int64).reshape(-1, 2)
            begin = np.concatenate([[0], np.cumsum([len(w) + 1 for w in part])])
            cut = np.searchsorted(off[:, 0], begin)
            own = (off - np.repeat(begin[:-1], np.diff(cut))[:, None]).astype(np.int32).tobytes()
            cut = (4 * cut).tolist()
            for w, i, j in zip(part, cut, cut[1:]):
                one = new[w] = raw[i:j] + own[2 * i : 2 * j]
                self.young_size += 240 + len(w) + len(one)
        if self.young_size > self.most:
            self.young, self.young_size = {}, 0
        else:
            self.young |= new
        return new

    def known(self, words: list[str]) -> list[bytes]:
        """Entries of words."""
        got = [*map(self.memo.get, words)]
        if None in got:
            lacks = dict.fromkeys([w for w, g in zip(words, got) if g is None])
            again = {w: x for w, x in zip(lacks, map(self.young.get, lacks)) if x is not None}
            new = self.learn([w for w in lacks if w not in again]) | again
            got = [new[w] if g is None else g for w, g in zip(words, got)]
            self.size += sum(240 + len(w) + len(x) for w, x in again.items())
            if self.size > self.most:
                self.memo, self.size = {}, 0
            self.memo |= again
        return got

    def short(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as bytes, decoded text) of texts by their words."""
        words = [_words(t) for t in texts]
        parts = [p[: len(p) // 3] for p in self.known([w for ws in words for w in ws])]
        out, at = [], 0
        for ws in words:
            ids = b"".join(parts[at : at + len(ws)])
            at += len(ws)
            out.append((ids, self.decode(np.frombuffer(ids, np.uint32))))
        return out

    def spans(self, text: str, base: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, starts and ends of the tokens of a text, offset by base."""
        found = [(m.start(), m[0]) for m in (_ODD if _odd(text) else _WORD).finditer(text)]
        parts = self.known([w for _, w in found])
        at = np.repeat(np.array([a for a, _ in found], np.int64), [len(p) // 12 for p in parts]) + base
        ids = np.frombuffer(b"".join([p[: len(p) // 3] for p in parts]), np.uint32)
        off = np.frombuffer(b"".join([p[len(p) // 3 :] for p in parts]), np.int32).reshape(-1, 2)
        return ids, off[:, 0] + at, off[:, 1] + at

    def decode(self, ids: np.ndarray) -> str:
        return " ".join([self.names[i] for i in ids.tolist()])


#: str.split() cuts at white space, which the tokenizer drops, and at these four characters, which it keeps.
_KEPT = "\x1c\x1d\x1e\x1f"
_WORD, _ODD = re.compile(r"\S+"), re.compile(r"[^ \t\n\r\x0b\x0c]+")


def _odd(text: str) -> bool:
    return any(c in text for c in _KEPT)


def _words(text: str) -> list[str]:
    return _ODD.findall(text) if _odd(text) else text.split()


def pack(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Three columns in the least widths that hold them: ids, steps between starts, lengths."""
    return tuple(np.dtype(t := np.min_scalar_type(int(x.max()) if len(x) else 0)).char.encode() + x.astype(t).tobytes() for x in (ids, np.diff(starts, prepend=0), ends - starts))


def unpack(ids: bytes, steps: bytes, lengths: bytes, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, d, n = (np.frombuffer(x[1:], x[:1].decode()).astype(np.int64) for x in (ids, steps, lengths))
    starts = np.cumsum(d) + base
    return i.astype(np.uint32), starts, starts + n


def encoder(path: str) -> Encoder:
    held = cache("bpe_tree")
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def _agreement(side, win, lo: int, hi: int, last: bool):
    """(position in side, position in win) just after (last: just before) a run of AGREE equal tokens, or None.

    Only tokens of the window inside (lo, hi) count. Runs that end at the boundary of a character are used.
    """
    where = {(s, e, i): k for k, (s, e, i) in enumerate(zip(side[1].tolist(), side[2].tolist(), side[0].tolist()))}
    rows = list(zip(win[1].tolist(), win[2].tolist(), win[0].tolist()))
    found = [k if lo < s and e < hi else None for k, (s, e, _) in enumerate(rows)]
    pos = [where.get(rows[k]) if k is not None else None for k in found]
    order = range(len(rows) - AGREE, -1, -1) if last else range(len(rows) - AGREE + 1)
    for k in order:
        run = pos[k : k + AGREE]
        if run[0] is not None and all(p == run[0] + j for j, p in enumerate(run)):
            a, b = (run[0], k) if last else (run[-1] + 1, k + AGREE)
            n, m = len(side[0]), len(rows)
            clear_side = a in (0, n) or side[2][a - 1] <= side[1][a]
            clear_win = b in (0, m) or rows[b - 1][1] <= rows[b][0]
            if clear_side and clear_win:
                return a, b
    return None


def join(enc: Encoder, text: str, cut: int, left, right, begin: int = 0, window: int = WINDOW):
    """Tokens of text (from begin on) from the tokens of its parts before and after cut."""
    end = begin + len(text)
    w = window
    while True:
        a, b = max(begin, cut - w), min(end, cut + w)
        win = enc.spans(text[a - begin : b - begin], a)
        x = (0, 0) if a == begin else _agreement(_near(left, a, cut), win, a, cut, False)
        y = (len(right[0]), len(win[0])) if b == end else _agreement(_near(right, cut, b), win, cut, b, True)
        if x is not None and y is not None:
            i = x[0] + (0 if a == begin else _skip(left, a, cut))
            j = y[0] + (0 if b == end else _skip(right, cut, b))
            if x[1] <= y[1]:
                return tuple(np.concatenate([p[:i], q[x[1] : y[1]], r[j:]]) for p, q, r in zip(left, win, right))
        w *= 2


def _skip(side, lo, hi) -> int:
    return int(np.searchsorted(side[1], lo))


def _near(side, lo, hi):
    i, j = np.searchsorted(side[1], lo), np.searchsorted(side[1], hi)
    return tuple(p[i:j] for p in side)


def encode_tree(enc: Encoder, text: str, leaves: list, cuts: list[int]):
    """Joins the tokens of leaves (cuts: where each begins, and the length at the end) pairwise up to the root."""
    while len(leaves) > 1:
        nxt, at = [], []
        for k in range(0, len(leaves), 2):
            at.append(cuts[k])
            if k + 1 < len(leaves):
                nxt.append(join(enc, text[cuts[k] : cuts[k + 2]], cuts[k + 1], leaves[k], leaves[k + 1], cuts[k]))
            else:
                nxt.append(leaves[k])
        leaves, cuts = nxt, [*at, cuts[-1]]
    return leaves[0]


_OUT = "doc_id long, n_tokens long, ids binary, decoded string"


def _result(ids: list, n: list, raw: list, decoded: list, digest: bool) -> pa.Table:
    if digest:
        raw = [hashlib.sha256(x).hexdigest().encode() for x in raw]
        decoded = [hashlib.sha256(x.encode()).hexdigest() for x in decoded]
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids": pa.array(raw, pa.binary()), "decoded": pa.array(decoded, pa.string())})


def _short(path: str, digest: bool):
    def run(batches):
        enc = encoder(path)
        for b in batches:
            for s in blocks(b, "text"):
                raw, decoded = zip(*enc.short([t or "" for t in s.column("text").to_pylist()]))
                yield from _result(s.column("doc_id").to_pylist(), [len(x) // 4 for x in raw], list(raw), list(decoded), digest).to_batches()
        release()

    return run


def _leaves(path: str):
    def run(batches):
        enc = encoder(path)
        for b in batches:
            out = [pack(*enc.spans(t)) for t in b.column("piece").to_pylist()]
            names = ["doc_id", "row", "copy", "at", "piece"]
            yield pa.record_batch([b.column(c) for c in names] + [pa.array([o[k] for o in out], pa.binary()) for k in range(3)], [*names, "ids", "starts", "ends"])
        release()

    return run


def _root(path: str, digest: bool):
    def run(table: pa.Table) -> pa.Table:
        enc = encoder(path)
        t = table.sort_by([("copy", "ascending"), ("at", "ascending")])
        copies = t["copy"].to_pylist()
        out = []
        for c in dict.fromkeys(copies):
            i, j = copies.index(c), len(copies) - copies[::-1].index(c)
            s = t.slice(i, j - i)
            text = "".join(s["piece"].to_pylist())
            leaves = [unpack(a, b, e, at) for a, b, e, at in zip(s["ids"].to_pylist(), s["starts"].to_pylist(), s["ends"].to_pylist(), s["at"].to_pylist())]
            ids = encode_tree(enc, text, leaves, [*s["at"].to_pylist(), len(text)])[0]
            out.append((s["doc_id"][0].as_py(), len(ids), ids.astype("<u4").tobytes(), enc.decode(ids)))
        return _result([o[0] for o in out], [o[1] for o in out], [o[2] for o in out], [o[3] for o in out], digest)

    return run


def encode_decode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit) and decoded; digest: ids and decoded are hexadecimal SHA-256."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = F.length("text")
    short = docs.where(size <= leaf).mapInArrow(_short(path, digest), _OUT)
    at = F.sequence(F.lit(0), size - 1, F.lit(leaf))
    long = docs.where(size > leaf).withColumn("row", F.xxhash64("doc_id", "text")).withColumn("copy", F.monotonically_increasing_id())
    pieces = long.select("doc_id", "row", "copy", F.explode(F.transform(at, lambda a: F.struct(a.cast("long").alias("at"), F.substring("text", a + 1, leaf).alias("piece")))).alias("p"))
    pieces = pieces.select("doc_id", "row", "copy", "p.at", "p.piece").repartition("row", "copy", "at")
    coded = pieces.mapInArrow(_leaves(path), "doc_id long, row long, copy long, at long, piece string, ids binary, starts binary, ends binary")
    return short.unionByName(coded.groupBy("row", "copy").applyInArrow(_root(path, digest), _OUT))
