"""SentencePiece BPE by a merge-type prefix table.

For a rank-merge tokenizer every prefix of a text has one encoding, so one last
token, and a token can follow another exactly if the two, joined, encode as
themselves.  An Aho-Corasick automaton reports the tokens that end at each
character; of those the one that is compatible with the last token of the prefix
before it is stored as this prefix's last token.  Ids are then read backwards from
the table's end.  Time is linear in the text whatever it looks like.

No token has a word mark after another character, so merges never cross from a
word to the next mark and the table is filled a word at a time; the ids of words
that aren't long and pairs' verdicts are remembered within fixed bounds.

Characters without a token become their UTF-8 bytes' ids; they cut the table.

Defined cases: a null text counts as empty and gives the begin and end ids
alone; repeated rows are encoded alike; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import ship, table
from blockloom.llm.words import slices

#: Fixed value: the mark that stands for a space.
MARK = "▁"
#: Most remembered words and pairs of a worker, beyond which they are made anew, and characters of a word that is remembered.
WORDS_HELD, PAIRS_HELD, WORD_HELD = 500_000, 500_000, 48


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Memo(dict):
    """A dict that makes what it lacks, keeps it if its key is no longer string than ``length``, and starts anew above ``most`` entries."""

    def __init__(self, make, most: int, length: int = 0) -> None:
        super().__init__()
        self.make, self.most, self.length = make, most, length

    def __missing__(self, key):
        value = self.make(key)
        if self.length and len(key) > self.length:
            return value
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


class Pieces:
    """Vocabulary, automaton and compatibility test of a SentencePiece BPE model."""

    def __init__(self, model_file: str) -> None:
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        text = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        self.byte_ids = [0] * 256
        self.bits, self.length, self.pack = max(1, (n - 1).bit_length()), [len(t) for t in text], struct.pack
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(text[i][1:-1], 16)] = i
        self.text = text
        self.rank = {text[i]: -sp.get_score(i) for i in range(n) if plain[i]}
        self.id_of = {text[i]: i for i in range(n) if plain[i]}
        # Neighbours that no token has never merge, so words can end before a mark.
        self.cut = all(MARK not in t.lstrip(MARK) for t in self.id_of)
        self.words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id_of.items():
            if self.merged(t) == [t]:  # others can't come out of merges
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.follows = _Memo(self._follows, PAIRS_HELD)
        self.ids_after_mark = _Memo(lambda word: self._encode(MARK + word), WORDS_HELD, WORD_HELD)
        shown = [b"" if sp.is_control(i) else bytes([int(text[i][1:-1], 16)]) if sp.is_byte(i) else text[i].replace(MARK, " ").encode() for i in range(n)]
        shown[self.unknown] = " ⁇ ".encode()
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_len = np.array([len(x) for x in shown])
        self.shown_at = np.cumsum(self.shown_len) - self.shown_len

    def merged(self, t: str) -> list[str]:
        """``t`` after all merges, best score first, leftmost among equals: for single tokens and joined pairs."""
        parts, rank = list(t), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, pair: int) -> bool:
        a, b = self.text[pair >> self.bits], self.text[pair & ((1 << self.bits) - 1)]
        return self.merged(a + b) == [a, b]

    def _encode(self, word: str) -> bytes:
        """Ids of a word as little-endian 32-bit integers, through the prefix table."""
        # -1: nothing before; -2: a character without a token, which never merges.
        last = [-2] * (len(word) + 1)
        last[0] = -1
        follows, bits = self.follows, self.bits
        for at, (i, k) in self.automaton.iter(word):
            if last[at + 1] == -2:
                p = last[at + 1 - k]
                if p < 0 or follows[p << bits | i]:
                    last[at + 1] = i
        out, end, length = [], len(word), self.length
        while end:
            i = last[end]
            if i >= 0:
                out.append(i)
                end -= length[i]
            else:
                out.extend(self.byte_ids[b] for b in reversed(word[end - 1].encode("utf-8")))
                end -= 1
        out.reverse()
        return self.pack(f"<{len(out)}I", *out)

    def encode(self, text: str) -> bytes:
        """Ids of a text between begin and end ids."""
        if not text:
            return np.array([self.begin, self.end], "<u4").tobytes()
        if self.cut and "  " not in text and text[0] != " " and MARK not in text:  # each word has one mark
            parts = map(self.ids_after_mark.__getitem__, text.split(" "))
        else:
            marked = (" " + text).replace(" ", MARK)
            parts = map(self._encode, self.words.findall(marked) if self.cut else [marked])
        return b"".join([self.pack("<I", self.begin), *parts, self.pack("<I", self.end)])

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids; ``sizes``: how many ids each has."""
        width = self.shown_len[ids]
        ends = np.cumsum(width)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) + np.repeat(self.shown_at[ids] - (ends - width), width)
        data = self.shown[source].tobytes()
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        out = (data[i:j].decode("utf-8", "replace") for i, j in zip(bounds[:-1], bounds[1:], strict=True))
        return [t[1:] if t[:1] == " " else t for t in out]


@lru_cache(maxsize=2)
def pieces(model_file: str) -> Pieces:
    return Pieces(model_file)


def encoded(df: DataFrame, id_col: str, text_col: str, model_file: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit integers) and ``decoded`` of every row."""
    ship(df.sparkSession)
    model = model_file or default_model()
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in slices(batches, "text", 1 << 20):
            ids = [own.encode(t or "") for t in batch.column("text").to_pylist()]
            sizes = np.array([len(x) // 4 for x in ids])
            text = own.decode(np.frombuffer(b"".join(ids), "<u4"), sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, decoded string")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    out = encoded(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
