"""BPE encoding and decoding of whole texts with a byte-level vocabulary file; nothing is trained.

Method: bounded-lookahead streaming transducer.  Whether two neighbouring tokens stay apart can depend on text further
to the right only along a chain of merges of falling rank, each of which takes away the left part of the next.
:func:`sufficient_lookahead` computes the longest such chain of the merge list in bytes.  The transducer merges a
buffer of bytes; every token that ends more than the lookahead before the buffer's end is stable and is emitted, and the
buffer goes on from there, so memory doesn't grow with a run of letters of any length.  Text is cut by the vocabulary's
pattern first; what it cuts off is decided within ``_TAIL`` characters, so that goes by slices as well.  Decoding is a
state machine from bytes to text: tokens go in one at a time, and text comes out as soon as its bytes are complete.

Strings of special tokens that occur in a text become those tokens, as the library does by default.

Defined cases: null text counts as empty and has no tokens (ids ``[]``); ids that decode to broken UTF-8 give U+FFFD as
the library does; repeated rows give a row each; an empty table gives an empty result; further columns are carried
along, except those named as a result column, which it replaces.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.scratch import bounded_batches
from hushframe.llm.words import trim

#: Pieces remembered with their tokens at most, and bytes of the longest.
REMEMBERED, LONGEST = 60_000, 48
SLICE, _TAIL = 1 << 16, 8
_SIMPLE = 24
#: Characters that ``regex`` takes for letters or numbers and the library, with an older Unicode, does not.
_NEWER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    r"\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    r"\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    r"\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Fixed value: how byte-level vocabularies of this kind cut text before merging.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?{O}+|\s+(?!\S)|\s+"


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: Iterable[tuple[int, int, int]], length: dict[int, int]) -> int:
    """Bytes to the right of a token boundary that can have a say in it, at most.

    ``merges``: left, right and new token by rank.  A merge ``(u, v)`` doesn't happen if an earlier merge has taken ``v``,
    or the token at its right end, as its left part; that one in turn can depend on an earlier one in the same way, or
    ``v`` itself can depend on any of the merges it is made of.
    """
    taken: dict[int, int] = {}  # by token: the longest chain from a merge so far with the token as its left part
    edge: dict[int, int] = {}  # by token: the same for the tokens at its right end, while they were tokens
    inner: dict[int, int] = {}  # by token: the longest chain from a merge that it is made of
    most = 0
    for u, v, new in merges:
        reach = length[v] + max(taken.get(v, 0), edge.get(v, 0), inner.get(v, 0))
        edge[new] = max(edge.get(new, 0), edge.get(v, 0), taken.get(v, 0))
        inner[new] = max(inner.get(new, 0), reach, inner.get(u, 0), inner.get(v, 0))
        taken[u] = max(taken.get(u, 0), reach)
        most = max(most, reach)
    return most


class Transducer:
    """Encodes and decodes with one vocabulary file of the ``tokenizers`` library (byte-level BPE)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names, vocab = _byte_names(), spec["model"]["vocab"]
        self.bytes_of = {i: bytes(names[c] for c in t) for t, i in vocab.items()}
        self.first = [0] * 256
        for b in names.items():
            self.first[b[1]] = vocab[b[0]]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        steps = []
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[vocab[a], vocab[b]] = rank
            self.made.append(vocab[a + b])
            steps.append((vocab[a], vocab[b], vocab[a + b]))
        length = {i: len(b) for i, b in self.bytes_of.items()}
        self.lookahead = sufficient_lookahead(steps, length)
        # Whatever token stands first, it ends more than the lookahead before the buffer's end.
        self.buffer = max(256, 2 * self.lookahead, self.lookahead + max(length.values(), default=0) + 1)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        space, letter, number = r"\t-\r \x85\xa0", "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
        latin = _CUT.replace("{L}", f"[{letter}]").replace("{N}", f"[{number}]").replace("{O}", f"[^{space}{letter}{number}]")
        self.latin = re.compile(latin.replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]"))
        self.beyond_latin = re.compile("[^\x00-ɏ]")
        sets = lambda letter, number, other: regex.compile(_CUT.replace("{L}", letter).replace("{N}", number).replace("{O}", other), regex.V1)
        self.pattern = sets(r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]")
        self.newer = regex.compile(f"[{_NEWER}]")
        self.pattern_newer = sets(rf"[\p{{L}}--[{_NEWER}]]", rf"[\p{{N}}--[{_NEWER}]]", rf"[[^\s\p{{L}}\p{{N}}]||[{_NEWER}]]")
        self.known: dict[str, tuple[int, ...]] = {}

    def forget(self) -> None:
        """Let the remembered pieces go at the end of a task."""
        self.known.clear()
        trim()

    # Encoding

    def _merged(self, b: bytes) -> list[int]:
        """All merges of the bytes of one buffer."""
        ids = [self.first[x] for x in b]
        get = self.rank.get
        if len(ids) <= _SIMPLE:
            none = len(self.made)
            found = [get(p, none) for p in zip(ids, ids[1:])]
            while found and (best := min(found)) < none:
                i = found.index(best)
                ids[i] = self.made[best]
                del ids[i + 1], found[i]
                if i:
                    found[i - 1] = get((ids[i - 1], ids[i]), none)
                if i < len(found):
                    found[i] = get((ids[i], ids[i + 1]), none)
            return ids
        n = len(ids)
        after, before, live = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, a, c = heapq.heappop(heap)
            if not live[i] or ids[i] != a or (j := after[i]) >= n or ids[j] != c:
                continue
            ids[i], live[j], after[i] = self.made[best], False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (m := get((ids[i], ids[after[i]]))) is not None:
                    heapq.heappush(heap, (m, i, ids[i], ids[after[i]]))
            if (k := before[i]) >= 0 and (m := get((ids[k], ids[i]))) is not None:
                heapq.heappush(heap, (m, k, ids[k], ids[i]))
        return [x for x, y in zip(ids, live) if y]

    def transduce(self, chunks: Iterable[bytes]) -> Iterator[list[int]]:
        """Tokens of one piece that comes in parts, as they become stable."""
        held = b""
        for chunk in chunks:
            held += chunk
            while len(held) > self.buffer:
                out, end = [], 0
                for t in self._merged(held[: self.buffer]):
                    if end + len(self.bytes_of[t]) >= self.buffer - self.lookahead:
                        break
                    out.append(t)
                    end += len(self.bytes_of[t])
                yield out
                held = held[end:]
        if held:
            yield self._merged(held)

    def _piece(self, piece: str) -> tuple[int, ...]:
        b = piece.encode()
        if len(b) > self.buffer:
            step = self.buffer
            return tuple(chain.from_iterable(self.transduce(b[i : i + step] for i in range(0, len(b), step))))
        got = tuple(self._merged(b))
        if len(b) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = got
        return got

    def _plain(self, text: str) -> Iterator[list[int]]:
        at, size = 0, SLICE
        # The same cuts three ways: the standard module is the fastest and knows no Unicode properties.
        cut = self.latin if not self.beyond_latin.search(text) else self.pattern_newer if self.newer.search(text) else self.pattern
        while at < len(text):
            part = text[at : at + size] if at or len(text) > size else text
            pieces = cut.findall(part)
            if at + size < len(text):
                end, most = len(part), len(part) - _TAIL
                while pieces and end > most:
                    end -= len(pieces.pop())
                if not pieces:
                    size *= 2
                    continue
                at, size = at + end, SLICE
            else:
                at = len(text)
            known = self.known
            try:
                yield list(chain.from_iterable([known[p] for p in pieces]))
            except KeyError:
                yield list(chain.from_iterable([known.get(p) or self._piece(p) for p in pieces]))

    def encode(self, text: str) -> Iterator[list[int]]:
        """Tokens of a text, in parts."""
        if self.at_special is None or not any(s in text for s in self.special):
            yield from self._plain(text)
            return
        for part in self.at_special.split(text):
            if part in self.special:
                yield [self.special[part]]
            elif part:
                yield from self._plain(part)

    # Decoding

    def decode(self, parts: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of tokens that come in parts, as its bytes become complete."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        get = self.bytes_of.__getitem__
        for part in parts:
            if out := machine.decode(b"".join(map(get, part))):
                yield out
        if out := machine.decode(b"", True):
            yield out


@functools.cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, check: bool = False) -> DataFrame:
    """All columns of ``docs`` (which needs ``text``) and ``ids`` (array of int); with ``check`` ``decodes`` as well:
    whether the ids decode to the text, found in the same pass by the same worker."""
    bounded_batches(docs.sparkSession)
    docs, path = docs.drop("ids", *["decodes"] * check), path or default_path()
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            parts, same = [], []
            for x in batch.column(place):
                text = x.as_py() or ""
                parts.append(np.fromiter(chain.from_iterable(t.encode(text)), np.int32))
                if check:
                    same.append("".join(t.decode(parts[-1][i : i + SLICE].tolist() for i in range(0, len(parts[-1]), SLICE))) == text)
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, *[pa.array(same, pa.bool_())] * check], [*batch.schema.names, "ids", *["decodes"] * check])
        t.forget()

    return docs.mapInArrow(run, docs.select("*", F.expr("array(1)").alias("ids"), *[F.lit(True).alias("decodes")] * check).schema)


def decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of ``df`` (which needs ``ids``) and ``decoded``; null ids decode to the empty text."""
    df, path = df.drop("decoded"), path or default_path()
    place = df.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            text = pa.array(["".join(t.decode([x.values.to_numpy().tolist()] if x.is_valid else [])) for x in batch.column(place)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, "decoded"])

    return df.mapInArrow(run, df.select("*", F.lit("").alias("decoded")).schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of ``docs`` but ``text``, and n_tokens, ids_sha256 and decoded_sha256: tokens go from the encoder to
    the decoder part by part and are never held as a whole."""
    path, place = path or default_path(), docs.columns.index("text")
    docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256")
    place, rest = docs.columns.index("text"), [i for i, c in enumerate(docs.columns) if c != "text"]

    def digests(t: Transducer, decimal: dict[int, str], text: str) -> tuple[int, str, str]:
        n, ids, out, machine = 0, hashlib.sha256(), hashlib.sha256(), []
        for part in t.encode(text):
            if part:
                ids.update(("," if n else "").encode() + ",".join([decimal[i] for i in part]).encode())
                n += len(part)
                machine.append(part)
                if n >= 1 << 16:
                    break
        else:
            for s in t.decode(machine):
                out.update(s.encode())
            return n, ids.hexdigest(), out.hexdigest()
        # A long text: both directions again, side by side.
        n, ids = 0, hashlib.sha256()

        def tapped() -> Iterator[list[int]]:
            nonlocal n
            for part in t.encode(text):
                if part:
                    ids.update(("," if n else "").encode() + ",".join([decimal[i] for i in part]).encode())
                    n += len(part)
                    yield part

        for s in t.decode(tapped()):
            out.update(s.encode())
        return n, ids.hexdigest(), out.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        decimal = {i: str(i) for i in t.bytes_of}
        for batch in batches:
            got = [digests(t, decimal, x.as_py() or "") for x in batch.column(place)]
            columns = [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), *columns], [*(batch.schema.names[i] for i in rest), "n_tokens", "ids_sha256", "decoded_sha256"])
        t.forget()

    return docs.mapInArrow(run, docs.drop("text").select("*", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema)


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
