"""Exact token counts of every prefix, by dynamic programming.

The tokenizer is a public byte-level BPE, given by its rank file. A text is split into pieces by its pattern; within a
piece, the last token of the encoding of prefix i is the only token t ending at i for which t can follow the last token
of prefix i - |t|, that is, the two alone encode as themselves. So ``count[i] = count[i - |t|] + 1``, for
all prefixes in one pass. Counts of a text's prefix are those of the pieces before plus that of the piece's prefix,
except where a prefix splits otherwise than the whole text: at the end of a run of blanks, of which the last
goes to the next word only if there is one, and inside a contraction of three characters.

A text's counts are stored as ``prefix_counts``: the count at every character, in order, as first differences of one byte
(tag b"\\x01") or four (b"\\x04"), compressed. ``counts_of`` unpacks them, ``count_at`` and ``longest_within`` answer
questions of truncation and budget without encoding again. Counts may fall as a prefix grows; the longest prefix
within a budget is the last one whose own count is within it.

Cases: a null text has null results, an empty one counts 0. Rows are taken one by one (repeated rows repeat) and whole;
strings of special tokens are ordinary text. Other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import arrow_map

#: Where the driver finds the rank file, and how many pieces, and characters of pieces, a worker remembers.
RANKS, BUDGETS, REMEMBERED, REMEMBERED_CHARS = "/opt/tokenizers/byte_bpe_50k.tiktoken", (256, 1024, 4096), 300_000, 8 << 20
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_counters: dict[int, PrefixCounter] = {}


class PrefixCounter:
    """Prefix counts of texts under one rank file (its lines), remembering pieces."""

    def __init__(self, lines: bytes, remembered: int = REMEMBERED, remembered_chars: int = REMEMBERED_CHARS) -> None:
        import regex
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        #: How long a token is at most that ends in these (three or fewer) bytes.
        self.longest: dict[bytes, int] = {}
        for token in self.ranks:
            self.longest[token[-3:]] = max(len(token), self.longest.get(token[-3:], 0))
        self.coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.split = regex.compile(PATTERN).findall
        self.follows: dict[int, bool] = {}
        self.remembered, self.remembered_chars = remembered, remembered_chars
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.new_counts: list[int] = []
        self.new_about: list[tuple[int, int, bool, bool]] = []
        #: Of each piece by number: where its counts start, how many, whether it is blank, whether it starts so.
        self.about = np.zeros((1 << 12, 4), np.int64)

    def piece(self, p: bytes) -> list[int]:
        """The token count of each byte prefix of a piece, from 1 byte on."""
        rank, follows, n, longest = self.ranks.get, self.follows.get, len(p), self.longest.get
        last, count, first, can_follow = [0] * (n + 1), [0] * (n + 1), 0, self.can_follow
        for i in range(1, n + 1):
            # Only one start is right, so the likely ones may come first: the last token's own, then a new token.
            t = rank(p[first:i])
            if t is not None:
                if not first:
                    last[i], count[i] = t, 1
                    continue
                ok = follows(last[first] << 20 | t)
                if ok is None:
                    ok = can_follow(last[first], p[first:i], t)
                if ok:
                    last[i], count[i] = t, count[first] + 1
                    continue
            j = i - 1
            t = rank(p[j:i])
            ok = not j or follows(last[j] << 20 | t)
            if ok is None:
                ok = can_follow(last[j], p[j:i], t)
            if not ok:
                for j in range(max(0, i - longest(p[max(0, i - 3) : i], 2)), j):
                    t = rank(p[j:i])
                    if t is not None:
                        ok = not j or follows(last[j] << 20 | t)
                        if ok is None:
                            ok = can_follow(last[j], p[j:i], t)
                        if ok:
                            break
            last[i], count[i], first = t, count[j] + 1, j
        return count[1:]

    def can_follow(self, one: int, raw: bytes, two: int) -> bool:
        ok = self.follows.get(one << 20 | two)
        if ok is None:
            if len(self.follows) > 1_000_000:
                self.follows.clear()
            both = self.coder._encode_single_piece(self.coder.decode_single_token_bytes(one) + raw)
            self.follows[one << 20 | two] = ok = both == [one, two]
        return ok

    def learn(self, piece: str) -> int:
        raw = piece.encode("utf-8", "surrogatepass")
        counts = self.piece(raw)
        if len(raw) != len(piece):
            ends = [i for i in range(len(raw)) if i + 1 == len(raw) or (raw[i + 1] & 0xC0) != 0x80]
            counts = [counts[i] for i in ends]
        if len(piece) == 3 and piece in ("'re", "'ve", "'ll"):
            counts[1] = 2
        n = len(counts)
        self.place[piece] = k = len(self.place)
        self.new_counts += counts
        self.new_about.append((self.used, n, piece.isspace(), piece[0].isspace()))
        self.used += n
        return k

    def keep(self) -> None:
        """What was learned goes to the arrays, all at once."""
        if not self.new_about:
            return
        if self.used > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(max(self.used - len(self.flat), len(self.flat)), np.int32)))
        self.flat[self.used - len(self.new_counts) : self.used] = self.new_counts
        if len(self.place) > len(self.about):
            self.about = np.concatenate((self.about, np.zeros((max(len(self.place) - len(self.about), len(self.about)), 4), np.int64)))
        self.about[len(self.place) - len(self.new_about) : len(self.place)] = self.new_about
        self.new_counts, self.new_about = [], []

    def counts(self, text: str) -> np.ndarray:
        """The exact token count of each prefix, from 1 character on."""
        pieces = self.split(text)
        if not pieces:
            return np.zeros(0, np.int32)
        if len(self.place) > self.remembered or self.used > self.remembered_chars:
            self._forget()
        get = self.place.get
        ids = list(map(get, pieces))
        if None in ids:
            for i, k in enumerate(ids):
                if k is None:
                    ids[i] = get(pieces[i])
                    if ids[i] is None:
                        ids[i] = self.learn(pieces[i])
            self.keep()
        about = self.about[np.array(ids)]
        s, n = about[:, 0], about[:, 1]
        ends = np.cumsum(n)
        total = self.flat[s + n - 1]
        base = np.cumsum(total) - total
        out = self.flat[np.repeat(s - (ends - n), n) + np.arange(ends[-1])] + np.repeat(base, n).astype(np.int32)
        run = np.flatnonzero(about[:-1, 2] & about[1:, 3])
        for k in run.tolist():
            whole = pieces[k] + pieces[k + 1][0]
            w = get(whole)
            if w is None:
                w = self.learn(whole)
                self.keep()
            out[ends[k]] = base[k] + self.flat[self.about[w, 0] + self.about[w, 1] - 1]
        return out


def rank_lines(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def counter(lines: bytes) -> PrefixCounter:
    """The worker's counter for a rank file's lines."""
    key = zlib.crc32(lines)
    if key not in _counters:
        _counters.clear()
        _counters[key] = PrefixCounter(lines)
    return _counters[key]


def pack(counts: np.ndarray) -> bytes:
    steps = np.diff(counts, prepend=0)
    small = not len(steps) or np.abs(steps).max() < 128
    return (b"\x01" if small else b"\x04") + zlib.compress(steps.astype(np.int8 if small else np.int32).tobytes(), 1)


def counts_of(packed: bytes) -> np.ndarray:
    """The count at each prefix, from 1 character on."""
    return np.cumsum(np.frombuffer(zlib.decompress(packed[1:]), np.int8 if packed[:1] == b"\x01" else np.int32), dtype=np.int64)


def count_at(packed: bytes, chars: int) -> int:
    """Tokens of the first ``chars`` characters (of the whole text if it is shorter)."""
    c = counts_of(packed)
    return int(c[min(chars, len(c)) - 1]) if len(c) and chars > 0 else 0


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix that counts at most ``budget`` tokens."""
    at = np.flatnonzero(counts <= budget)
    return int(at[-1]) + 1 if len(at) else 0


def token_prefixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ranks: str = RANKS, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """(id_col, tokens, prefix_counts, and chars_<budget> for each budget) for each row of docs. No shuffle.

    The driver reads the rank file and broadcasts it (under 1 MB); workers need no such file.
    """
    lines_of = docs.sparkSession.sparkContext.broadcast(rank_lines(ranks))
    schema = pa.schema([("id", pa.int64()), ("tokens", pa.int64()), ("prefix_counts", pa.binary()), *[(f"chars_{b}", pa.int64()) for b in budgets]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(lines_of.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = []
                for text in part.column(1).to_pylist():
                    if text is None:
                        rows.append((None,) * (2 + len(budgets)))
                        continue
                    c = own.counts(text)
                    rows.append((int(c[-1]) if len(c) else 0, pack(c), *[longest_within(c, b) for b in budgets]))
                columns = [pa.array([r[i] for r in rows], schema.field(i + 1).type) for i in range(2 + len(budgets))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=schema)

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = "".join(f", chars_{b} long" for b in budgets)
    return arrow_map(own, run, f"id long, tokens long, prefix_counts binary{kinds}").withColumnRenamed("id", id_col)
