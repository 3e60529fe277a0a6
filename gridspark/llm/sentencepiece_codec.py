"""SentencePiece BPE encoding by a prefix table, and decoding.

For every prefix of a text the merge order fixes one last token. It is found among the pieces that an automaton finds
to end there, as the one that may follow the last token of what stands before it: two tokens may stand side by side if
merging the characters of both would never join across them. The ids are read off from the end. The work is linear in
the length of the text. Where no piece has a space mark after another character, a text falls apart before each run
of marks, so distinct words are encoded once and kept in a dictionary of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.mixing import PLACE

MODEL = "piece_bpe_32k.model"
KEPT_WORDS = 400_000
"""Words kept by a worker; beyond that the dictionary is emptied. It changes the speed only."""
KEPT_JOINS = 2_000_000
"""Pairs of tokens kept likewise."""
KEPT_CHARS = 64
"""Longer words are not kept."""
MARK = "\u2581"
_MARKED = re.compile(f"{MARK}+[^{MARK}]*")


class Codec:
    """Pieces of a model and the tables that encoding needs."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = {}
        self.hidden = set()
        self.rank: dict[str, float] = {}
        ids: dict[str, int] = {}
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif model.is_control(i):
                self.hidden.add(i)
            elif not model.is_unknown(i) and not model.is_unused(i):
                ids[piece], self.rank[piece] = i, -model.get_score(i)
        self.unknown = model.unk_id()
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        # by decimal id: the text of what stands for itself, a piece or a byte of ASCII (but for a blank, which is not taken off in front)
        self.plain = {str(i): self.pieces[i].replace(MARK, " ") for i in ids.values()} | {str(i): chr(b) for b, i in self.byte_ids.items() if b < 128 and b != 32}
        # a piece of several characters is made by one last merge, of these two
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.ids = {}
        for piece, i in ids.items():
            parts, last = self._merge(piece)
            if len(parts) == 1:
                self.ids[piece], self.halves[piece] = i, last
        self.by_mark = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, (self.ids[piece], len(piece)))
        self.automaton.make_automaton()
        self.known = frozenset(p for p in self.ids if len(p) == 1)
        # by left id * number of pieces + right id: may they stand side by side?
        self.joins: dict[int, bool] = {}
        self.words: dict[str, tuple[str, int]] = {}

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merge the characters of a short text in the order of the ranks; used for the pieces themselves only."""
        parts, last = list(text), None
        while len(parts) > 1:
            best = min(((self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            last = parts[k], parts[k + 1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts, last

    def compatible(self, left: str, right: str) -> bool:
        """May the two tokens stand side by side in an encoding?

        Undo the later of the two tokens' last merges, half by half, as long as a merge across the border would have
        come first; if one would, the pair can't stand. Of equal ranks the left one comes first.
        """
        a, b, result = left, right, True
        limit: tuple[float, int] = (float("inf"), 0)
        while True:
            joined = self.rank.get(a + b)
            if joined is not None and self._before(joined, limit):
                result = False
                break
            made_a = self.rank[a] if self.halves.get(a) else None
            made_b = self.rank[b] if self.halves.get(b) else None
            if made_a is None and made_b is None:
                break
            # the merge made last is undone first; of equal ranks the right one is made last
            if made_b is None or (made_a is not None and made_a > made_b):
                limit, a = (made_a, 0), self.halves[a][1]
            else:
                limit, b = (made_b, 1), self.halves[b][0]
        return result

    @staticmethod
    def _before(joined: float, limit: tuple[float, int]) -> bool:
        """A merge across the border comes before one within the left token only if its rank is lower; before one within the right token also at the same rank."""
        return joined < limit[0] or (joined == limit[0] and limit[1] == 1)

    def _table(self, text: str) -> list[int]:
        """Ids of a text of known characters, through the table of each prefix's last token."""
        last, lengths = [-1] * len(text), [0] * len(text)
        joins, size = self.joins, len(self.pieces)
        for end, (piece, length) in self.automaton.iter(text):
            if last[end] >= 0:
                continue
            start = end - length
            if start >= 0:
                key = last[start] * size + piece
                stands = joins.get(key)
                if stands is None:
                    if len(joins) >= KEPT_JOINS:
                        joins.clear()
                    stands = joins[key] = last[start] >= 0 and self.compatible(self.pieces[last[start]], self.pieces[piece])
                if not stands:
                    continue
            last[end], lengths[end] = piece, length
        out, at = [], len(text) - 1
        while at >= 0:
            out.append(last[at])
            at -= lengths[at]
        return out[::-1]

    def _word(self, word: str) -> list[int]:
        """Ids of a word; characters that are no piece become their bytes and part what stands around them."""
        if self.known.issuperset(word):
            return self._table(word)
        out: list[int] = []
        begin = 0
        for at, char in enumerate(word):
            if char not in self.known:
                if begin < at:
                    out += self._table(word[begin:at])
                out += [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]
                begin = at + 1
        return out + self._table(word[begin:]) if begin < len(word) else out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; null and empty have none."""
        joined, _ = self.encode_joined(text)
        return [int(x) for x in joined.split(",")] if joined else []

    def encode_joined(self, text: str | None) -> tuple[str, int]:
        """The ids as decimal numbers joined by commas, and how many there are."""
        if not text:
            return "", 0
        marked = MARK + text.replace(" ", MARK)
        words, kept, out, total = _MARKED.findall(marked) if self.by_mark else [marked], self.words, [], 0
        found = list(map(kept.get, words))
        if None not in found:
            return ",".join([x[0] for x in found]), sum([x[1] for x in found])
        for word, got in zip(words, found):
            if got is None and (got := kept.get(word)) is None:
                ids = self._word(word)
                got = ",".join(map(str, ids)), len(ids)
                if len(word) <= KEPT_CHARS:
                    if len(kept) >= KEPT_WORDS:
                        kept.clear()
                    kept[word] = got
            out.append(got[0])
            total += got[1]
        return ",".join(out), total

    def decode_joined(self, joined: str) -> str:
        """``decode`` of ids as decimal numbers joined by commas; by table lookups alone where all ids stand for themselves."""
        if not joined:
            return ""
        try:
            text = "".join(map(self.plain.__getitem__, joined.split(",")))
        except KeyError:
            return self.decode([int(i) for i in joined.split(",")])
        return text[1:] if text.startswith(" ") else text

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks become spaces but for one in front, runs of byte pieces are read as UTF-8."""
        out: list[str] = []
        run = bytearray()
        first = True
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                run.append(byte)
                first = False
                continue
            if run:
                out.append(_utf8(run))
                run.clear()
            if i in self.hidden:
                continue
            piece = " \u2047 " if i == self.unknown else self.pieces[i]
            out.append((piece[1:] if first and piece.startswith(MARK) else piece).replace(MARK, " "))
            first = False
        return "".join(out) + (_utf8(run) if run else "")


def _utf8(run: bytearray) -> str:
    """Bytes as text; each byte that belongs to no character becomes one U+FFFD."""
    out, at = [], 0
    while at < len(run):
        for width in (1, 2, 3, 4):
            try:
                out.append(bytes(run[at : at + width]).decode())
                at += width
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\ufffd")
            at += 1
    return "".join(out)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each model and worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def model_path(model: str | None = None) -> str:
    import public_tokenizers

    return model or public_tokenizers.path(MODEL)


def encode(docs: DataFrame, model: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, ids, n_tokens)`` of each whole text, and the columns ``keep`` as they are; null and empty texts have no ids, repeated rows stay."""
    path = model_path(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = [c.encode(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), *part.columns[2:]], names=["doc_id", "ids", "n_tokens", *keep])

    rows = docs.select("doc_id", "text", *keep)
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(apply, f"doc_id long, ids array<int>, n_tokens long{kept}")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``(doc_id, text)`` of ``encoded(doc_id, ids)``; null ids count as none."""
    path = model_path(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(apply, "doc_id long, text string")


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: encoding and decoding of each whole text, as digests."""
    path = model_path(model)

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            rows = []
            for x in batch.column(1):
                joined, n = c.encode_joined(x.as_py())
                rows.append((n, sha(joined), sha(c.decode_joined(joined))))
            n, ids, text = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def tokenise(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the ids of each document, and its place in the mix where a stage before has given one."""
    return encode(docs, keep=tuple(c for c in PLACE if c in docs.columns))
