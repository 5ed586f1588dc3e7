"""SentencePiece BPE encoding and decoding with a prefix table.

In the encoding of a text by merges, the encoding of every prefix ends in exactly one piece. The table
holds that piece for each prefix: an automaton reports the pieces that end at a place, and the one
whose left neighbour (the last piece of the prefix before it) is compatible with it is stored. Two
pieces are compatible if merging their joined text would leave exactly these two; the test undoes the
later of the two last merges again and again and asks whether what faces each other at the seam would
have been merged before. The ids come from walking the table backwards. Time is linear in the text.

No piece holds a space mark after another character, so no merge crosses the beginning of a word: the
table is filled word by word, and words seen before are looked up. Words may be of any length. What a worker
keeps of words is their ids as text; how a word's ids are decoded is kept only where it isn't the word itself.

Characters without a piece become their bytes' pieces. Decoding joins pieces, turns marks into spaces
and takes off the one space that encoding puts in front.

Defined results: null is the empty text, which has no ids. Rows are encoded one by one; repeated rows
and null ids are kept, other columns are not touched.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import give_back

MARK = "▁"
#: Words whose ids a worker keeps, half of them from before; and pairs of pieces.
CACHE = 250_000
#: Rows of which a task has texts and digests at a time.
AT_A_TIME = 1000
SEGMENT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


def load_vocabulary(path: str) -> dict:
    """Pieces by id, those that merges make by rank (earlier merges first), and the ids of bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
    pieces = {model.id_to_piece(i): i for i in range(size) if not special[i] and not model.is_unused(i)}
    order = sorted(pieces, key=lambda p: (-model.get_score(pieces[p]), pieces[p]))
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece holds a space mark inside; words can't be encoded one by one")
    if any("\n" in p for p in pieces):
        raise ValueError("a piece holds a line end; lines can't be encoded one by one")
    return {"pieces": pieces, "rank": {p: r for r, p in enumerate(order)}, "bytes": {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}, "unknown": model.unk_id()}


class Words(dict):
    """What `make` gives for a word, kept. `turn` lets go of all but the last words, and of those that have not been asked for since the turn before."""

    def __init__(self, make: Callable[[str], str]):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, word: str) -> str:
        found = self.before.pop(word, None)
        self[word] = found = self.make(word) if found is None else found
        return found

    def turn(self) -> None:
        self.before = dict(self)
        self.clear()


class Codec:
    def __init__(self, vocabulary: dict):
        self.ids, self.rank, self.bytes, self.unknown = vocabulary["pieces"], vocabulary["rank"], vocabulary["bytes"], vocabulary["unknown"]
        self.names = {i: p for p, i in self.ids.items()}
        self.values = {i: b for b, i in self.bytes.items()}
        self.sizes = {i: len(p) for p, i in self.ids.items()}
        self.characters = {p for p in self.ids if len(p) == 1}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.lefts: dict[int, dict[int, bool]] = {}
        self.pairs = 0
        self.words = Words(self._made)
        self.odd: dict[str, str] = {}

    @cached_property
    def automaton(self):
        """Reports the pieces that end at a place, longest first; pieces that merging can't reach are left out."""
        import ahocorasick

        out = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) == 1 or self.split(piece):
                lefts = self.lefts[i] = {}  # by the piece before: are they compatible?
                out.add_word(piece, (len(piece), i, lefts))
        out.make_automaton()
        return out

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two pieces of the last merge that makes this piece; None if merging its characters ends in something else."""
        if piece not in self.halves:
            parts, last = list(piece), None
            while len(parts) > 1:
                r, i = min((self.rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if r == 1 << 60:
                    last = None
                    break
                last = (parts[i], parts[i + 1])
                parts[i : i + 2] = ["".join(last)]
            self.halves[piece] = last
        return self.halves[piece]

    def compatible(self, left: str, right: str) -> bool:
        rank, split = self.rank, self.split
        before = 1 << 60  # merges at the seam count that come before this rank
        made_left, made_right = rank[left] if len(left) > 1 else -1, rank[right] if len(right) > 1 else -1
        while True:
            if rank.get(left + right, before) < before:
                return False
            if made_left > made_right:
                before, left = made_left, split(left)[1]
                made_left = rank[left] if len(left) > 1 else -1
            elif made_right == -1:
                return True
            else:  # of two equal merges the left one comes first, and the seam is left of this one
                before, right = made_right + 1, split(right)[0]
                made_right = rank[right] if len(right) > 1 else -1

    def run(self, word: str) -> list[int]:
        """Ids of a run of characters that all have pieces."""
        last, names, size_of = [0] * len(word), self.names, self.sizes
        last.append(-1)  # what is before the first character; any piece may follow
        for end, (size, piece, lefts) in self.automaton.iter(word):
            if last[end]:
                continue
            left = last[end - size]
            try:
                fits = lefts[left]
            except KeyError:
                fits = lefts[left] = left == -1 or self.compatible(names[left], names[piece])
                self.pairs += 1
            if fits:
                last[end] = piece
        if self.pairs >= CACHE:
            self.pairs = 0
            for lefts in self.lefts.values():
                lefts.clear()
        out, at = [], len(word) - 1
        while at >= 0:
            out.append(last[at])
            at -= size_of[last[at]]
        out.reverse()
        return out

    def word(self, word: str) -> list[int]:
        if self.characters.issuperset(word):
            return self.run(word)
        out: list[int] = []
        start = 0
        for at in range(len(word) + 1):
            if at == len(word) or word[at] not in self.characters:
                if at > start:
                    out += self.run(word[start:at])
                if at < len(word):
                    out += [self.bytes[b] for b in word[at].encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]
                start = at + 1
        return out

    @staticmethod
    def _spoken(key: str) -> str:
        """The word that a key of digest stands for."""
        return key[2:] if key[:2] == "\n\n" else key if key[:1] == "\n" else MARK + key

    def _made(self, key: str) -> str:
        """The ids of a key's word, as text; they are decoded, and what isn't the word itself is kept in odd."""
        word = self._spoken(key)
        ids = self.word(word)
        if (decoded := self._joined(ids)) != word.replace(MARK, " "):
            self.odd[key] = decoded
        return ",".join(map(str, ids))

    def _joined(self, ids: list[int]) -> str:
        """Text of the ids, with spaces for marks; runs of bytes are read as UTF-8, and a byte that can't be is replaced by itself."""
        names = self.names
        try:
            return "".join([names[i] for i in ids]).replace(MARK, " ")
        except KeyError:  # bytes among them
            pass
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.values:
                run.append(self.values[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i is not None:
                out.append(self.names.get(i, ""))
        return "".join(out).replace(MARK, " ")

    def encode(self, text: str | None) -> list[int]:
        return [i for w in self._words(text) for i in self.word(w)]

    def decode(self, ids: list[int]) -> str:
        return self._joined(list(ids)).removeprefix(" ")

    @staticmethod
    def _words(text: str | None) -> list[str]:
        return SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else []

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, digest of the ids and digest of the decoded text."""
        text, words, odd = text or "", self.words, self.odd
        if len(words) >= CACHE // 2:  # between texts, so that all words of a text are there
            words.turn()
            odd = self.odd = {k: d for k, d in odd.items() if k in words.before}
        if not text or MARK in text or "  " in text or text[0] == " ":
            keys = ["\n\n" + w for w in self._words(text)]
        else:  # single spaces: a word without a line end in front is one with a mark in front
            keys = []
            for i, line in enumerate(text.split("\n")):
                found = line.split(" ")
                if i:
                    found[0] = "\n" + found[0]
                keys += found
        ids = ",".join(map(words.__getitem__, keys))  # no word is without ids
        if odd.keys().isdisjoint(keys):
            decoded = text.replace(MARK, " ")
        else:
            decoded = "".join([odd[k] if k in odd else self._spoken(k).replace(MARK, " ") for k in keys]).removeprefix(" ")
        return (ids.count(",") + 1 if ids else 0), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()


def _utf8(run: bytes) -> str:
    out = []
    while run:
        try:
            out.append(run.decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            out.append(run[: e.start].decode("utf-8") + "�")
            run = run[e.start + 1 :]
    return "".join(out)


def _codec(documents: DataFrame, path: str):
    """A broadcast of the vocabulary, whose size the model file bounds."""
    return documents.sparkSession.sparkContext.broadcast(load_vocabulary(path))


def encode(documents: DataFrame, path: str) -> DataFrame:
    """The documents' columns and piece_ids."""
    shared = _codec(documents, path)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(shared.value)
        for texts in batches:
            yield pd.Series([codec.encode(t) for t in texts], dtype=object)

    return documents.withColumn("piece_ids", ids("text"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of encoded and piece_text; null ids are decoded as none."""
    shared = _codec(encoded, path)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(shared.value)
        for rows in batches:
            yield pd.Series([codec.decode([] if r is None else r) for r in rows], dtype=object)

    return encoded.withColumn("piece_text", text("piece_ids"))


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256; each text is encoded and its ids are decoded."""
    shared = _codec(documents, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_A_TIME):  # texts are made of a part of the batch at a time
                part = batch.slice(at, AT_A_TIME)
                gc.disable()  # words that are kept are many small objects, and none of them is in a cycle
                try:
                    rows = [codec.digest(t.as_py()) for t in part.column("text")]
                finally:
                    gc.enable()  # the worker goes on to other tasks
                made = [pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            batch = part = None  # before the next one is read
        del codec
        give_back()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(documents: DataFrame, path: str | None = None) -> DataFrame:
    return digests(documents, path or default_path())
