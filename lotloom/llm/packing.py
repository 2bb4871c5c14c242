"""Packing: first-fit decreasing over a tournament tree of free room, in randomised groups of documents.

Documents are cut every `length` ids; the pieces of each random group are packed by decreasing length into the
first sequence with enough room, which a tree over the sequences' free room finds in logarithmic time. Groups hold
GROUP documents on average, so a group's pieces (numbers only, not texts) fit one task at any input size.

Ids are those of a tokenizers file. If its normaliser and pre-tokenizer are known not to look across white space, the
ids of white-space chunks are remembered by each Python worker, in a table of bounded size.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotloom.llm.common import OWN, give_back, quoted, small_batches, text_or_empty

#: Documents in a group on average; bytes of chunks and their ids that a worker remembers, OVERHEAD for each included.
GROUP, REMEMBERED, OVERHEAD = 8192, 128 << 20, 160

#: What a file must say for its words to be encoded one by one.
_NORMALIZER = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SUFFIX, _LAST = "</w>", b"\xff"  # the byte 0xFF is in no UTF-8 text

_encoders: dict[str, Encoder] = {}


def _byte_of_char() -> dict[str, int]:
    """Bytes behind the characters of byte-level vocabularies: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Words(dict):
    """Ids of white-space chunks (UTF-8) as bytes, found on demand and remembered up to REMEMBERED bytes.

    A chunk is cut as the file's pre-tokenizer cuts it. Pieces go through tiktoken's merge loop over the same
    vocabulary, a word's end being written as a byte of its own. In such a vocabulary every token comes from its own
    merge, whose parts have lower ids, so joining the pair with the least id is joining the pair of the first merge.
    Chunks that normalisation might change are left to the tokenizer itself.
    """

    def __init__(self, tokenizer, vocabulary: dict[str, int]):
        import regex
        import tiktoken

        super().__init__()
        self.held = 0
        of, ranks = _byte_of_char(), {}
        for token, i in vocabulary.items():
            if all(c in of for c in token.removesuffix(_SUFFIX)):
                ranks[bytes(of[c] for c in token.removesuffix(_SUFFIX)) + _LAST * token.endswith(_SUFFIX)] = i
        ranks[_LAST] = max(ranks.values()) + 1
        for token in [t for t in ranks if _LAST in t[:-1]]:
            del ranks[token]
        self.encode = tokenizer.encode
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.pieces = regex.compile(_PIECES).findall

    def __missing__(self, chunk: bytes) -> bytes:
        word = chunk.decode()
        if word.isascii():
            # only ASCII is lower-cased here: other letters may be composed before, and differently so in lower case
            if (low := word.lower()) != word:
                out = self[low.encode()]
            else:
                ids = self.merge(chunk + _LAST) if word.isalpha() else [i for p in self.pieces(word) for i in self.merge(p.encode() + _LAST)]
                out = array("I", ids).tobytes()
        elif word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word):
            out = array("I", self.merge(chunk + _LAST)).tobytes()
        else:
            out = array("I", self.encode(word, add_special_tokens=False).ids).tobytes()
        self.held += len(chunk) + len(out) + OVERHEAD
        if self.held > REMEMBERED:
            self.clear()
            self.held = len(chunk) + len(out) + OVERHEAD
        self[chunk] = out
        return out


class Encoder:
    """Token ids of texts, as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        steps = [(x["type"], (x.get("pattern") or {}).get("Regex")) for x in (told["normalizer"] or {}).get("normalizers", [])]
        cuts = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
        model = told["model"]
        by_word = (
            steps == _NORMALIZER
            and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["pattern"] == {"Regex": _PIECES} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
            and not cuts[1]["add_prefix_space"]
            and model["type"] == "BPE" and model["end_of_word_suffix"] == _SUFFIX
            and not (model["dropout"] or model["ignore_merges"] or model["byte_fallback"] or model["continuing_subword_prefix"])
            and not told["truncation"] and not told["padding"]
        )
        self.words = Words(self.tokenizer, model["vocab"]) if by_word else None

    def encode(self, text: bytes) -> bytes:
        # special tokens that a text spells out are found across chunks, so such texts are left as they are
        if self.words is None or b"<|" in text:
            return array("I", self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.words.__getitem__, text.split()))


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; it outlives the task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def first_fit_decreasing(lengths: list[int], room: int) -> list[tuple[int, int]]:
    """For each piece its bin and offset. Equal lengths keep their order.

    The tree's leaves are bins in order of opening, each inner node holds the largest free room below it.
    """
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    free, out = [room] * (2 * leaves), [(0, 0)] * len(lengths)
    for i in order:
        need, node = lengths[i], 1
        while node < leaves:
            node *= 2
            if free[node] < need:
                node += 1
        out[i] = (node - leaves, room - free[node])
        free[node] -= need
        while node > 1:
            node //= 2
            a, b = free[2 * node], free[2 * node + 1]
            free[node] = a if a > b else b
    return out


def pack(
    df: DataFrame,
    tokenizer: str,
    end_id: int,
    length: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A document is its ids and end_id; a null or empty text is end_id alone. Pieces hold `length` ids but for a
    document's last. A sequence holds pieces of up to `length` ids in all, without gaps from 0; sequence_id is
    unique, not gapless. Repeated ids are documents of their own; an empty table gives an empty result. Columns of
    df other than id and text are not read.
    """
    ids_type = "ids array<int>, " if with_ids else ""
    schema = f"{OWN}id long, {OWN}group long, {OWN}row long, start long, length long, ids_crc32 long, {ids_type}doc_tokens long"
    docs = df.select(
        F.col(quoted(id_col)).cast("long").alias(f"{OWN}id"),
        text_or_empty(quoted(text_col)).alias(f"{OWN}text"),
        F.monotonically_increasing_id().alias(f"{OWN}row"),
    )
    groups = max(1, -(-df.count() // GROUP))
    docs = docs.withColumn(f"{OWN}group", F.pmod(F.xxhash64(F.lit(seed), f"{OWN}id", f"{OWN}row"), F.lit(groups)))
    end = array("I", [end_id]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            names = {n: batch.column(n) for n in batch.schema.names}
            texts = names[f"{OWN}text"].cast(pa.binary()).to_pylist()
            out: dict[str, list] = {k: [] for k in ("of", "start", "length", "crc", "ids", "tokens")}
            for i, text in enumerate(texts):
                b = own.encode(text) + end
                for s in range(0, len(b), 4 * length):
                    piece = b[s : s + 4 * length]
                    out["of"].append(i)
                    out["start"].append(s // 4)
                    out["length"].append(len(piece) // 4)
                    out["crc"].append(zlib.crc32(piece))
                    out["tokens"].append(len(b) // 4)
                    if with_ids:
                        out["ids"].append(array("i", piece).tolist())
            of = pa.array(out["of"], pa.int64())
            cols = {n: names[n].take(of) for n in (f"{OWN}id", f"{OWN}group", f"{OWN}row")}
            cols |= {"start": pa.array(out["start"], pa.int64()), "length": pa.array(out["length"], pa.int64()), "ids_crc32": pa.array(out["crc"], pa.int64())}
            if with_ids:
                cols["ids"] = pa.array(out["ids"], pa.list_(pa.int32()))
            cols["doc_tokens"] = pa.array(out["tokens"], pa.int64())
            yield pa.RecordBatch.from_pydict(cols)
        give_back()

    small_batches(df.sparkSession)
    pieces = docs.mapInArrow(cut, schema)

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([(f"{OWN}id", "ascending"), (f"{OWN}row", "ascending"), ("start", "ascending")])
        bins = first_fit_decreasing(table["length"].to_pylist(), length)
        group = table[f"{OWN}group"][0].as_py() << 32
        table = table.append_column("sequence_id", pa.array([group + b for b, _ in bins], pa.int64()))
        table = table.append_column("offset", pa.array([o for _, o in bins], pa.int64()))
        return table.drop_columns([f"{OWN}group", f"{OWN}row"]).rename_columns({f"{OWN}id": id_col})

    out = f"{quoted(id_col)} long, start long, length long, ids_crc32 long, {ids_type}doc_tokens long, sequence_id long, offset long"
    return pieces.groupBy(f"{OWN}group").applyInArrow(place, out)
