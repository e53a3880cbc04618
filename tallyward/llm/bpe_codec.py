"""BPE encoding and decoding with content-defined chunks that documents share.

A rolling hash over the UTF-8 bytes cuts a text where its value meets a mask, so equal passages of different documents
give equal chunks wherever they stand.  A chunk that a worker has met before is not encoded again: what is kept of a
chunk is the encoding of its *core* (from its first to its last white space) and its ragged ends.

Chunks are cut without regard for words, so the join of two chunks has to be repaired: a window of text around it is
encoded again as one piece by the library, and its ids must begin and end with just those that the chunks have for the
same words on both sides.  As long as they don't agree the window is widened over more words of both cores, at last over
all of them; a text whose joins never agree is encoded whole.  Where a chunk has no white space at all the window grows
over further chunks until it has.

Within a core, the pieces that the encoder's own pattern makes (words, mostly) are encoded by the library once and kept.
All caches are bounded, and their content never changes a result.  This holds for files whose normaliser and pattern are
those below, which never let a token, a normalisation or an added token reach over white space; with any other file
texts are encoded whole by the library.

Cases: null and empty texts encode to no ids and decode to the empty text; very long texts are encoded whole; repeated
rows give repeated results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyward.llm import textkit

WINDOW = 32
CHUNK_LEAST, CHUNK_MEAN, CHUNK_MOST = 256, 1024, 8192
CACHE_WORDS, CACHE_CHUNK_BYTES = 400_000, 24 << 20

#: White space for the joins: a subset of what the encoder treats as white space.
_BREAK = re.compile(r"[ \t\n\r]")
_WORDS = re.compile(r"[^ \t\n\r]+")

#: Texts of these characters only are split here as the encoder's own pattern splits them, after lower-casing; they are
#: in composed form, and hold no added token ("<" is left out).  What has others goes to the library word by word.
_PLAIN = re.compile(r"[^\n\r\t -;=-~À-ÖØ-öø-ÿ]")
_ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
_ASCII = re.compile(rf"[a-z]+|[0-9]|{_ENDINGS}|[^ \t\n\ra-z0-9]+")
_LATIN = re.compile(rf"[a-zß-öø-ÿ]+|[0-9]|{_ENDINGS}|[^ \t\n\ra-z0-9ß-öø-ÿ]+")


# The normaliser and the pre-tokeniser of files whose texts may be cut at white space.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}


def cut_at_white_space(file: dict) -> bool:
    """Whether the texts of a tokenizer file may be cut at white space, as this module does."""
    model, added = file["model"], file.get("added_tokens") or []
    apart = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) and not re.search(r"\s", t["content"]) and "<" in t["content"] for t in added)
    return (file.get("normalizer"), file.get("pre_tokenizer")) == (_NORMALIZER, _PRE_TOKENIZER) and apart and model["type"] == "BPE" and not (model.get("dropout") or model.get("unk_token") or model.get("ignore_merges"))


class Bounded(dict):
    """A cache in two generations: when the younger is full it becomes the older, which is then forgotten."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.held, self.older = limit, 0, {}

    def find(self, key):
        value = self.get(key)
        return self.older.get(key) if value is None else value

    def keep(self, key, value, weight: int = 1) -> None:
        self[key] = value
        self.held += weight
        if self.held > self.limit // 2:
            self.older, self.held = dict(self), 0
            self.clear()


def _last_words(core: str, n: int) -> str:
    """The end of a core that holds its last n words."""
    at = len(core)
    for _ in range(n):
        while at and core[at - 1] in " \t\n\r":
            at -= 1
        while at and core[at - 1] not in " \t\n\r":
            at -= 1
    # From the white space in front of the word; all of the core, if there is no more.
    return core[max(0, at - 1) :] if core[:at].strip(" \t\n\r") else core


def _first_words(core: str, n: int) -> str:
    """The start of a core that holds its first n words."""
    at = 0
    for _ in range(n):
        while at < len(core) and core[at] in " \t\n\r":
            at += 1
        while at < len(core) and core[at] not in " \t\n\r":
            at += 1
    return core[: at + 1] if core[at:].strip(" \t\n\r") else core


def cut_points(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each of several texts, given as consecutive UTF-8 bytes, where its chunks begin and end, by content."""
    n = len(data)
    power, inverse = textkit._power_tables(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(textkit._BYTE_VALUES[data] * power[:n], out=sums[1:])
    size = max(0, n - WINDOW + 1)
    rolling = textkit.mix64((sums[WINDOW:] - sums[:size]) * inverse[:size])
    hits = np.flatnonzero(rolling < np.uint64((1 << 64) // (CHUNK_MEAN - CHUNK_LEAST))) + WINDOW
    out = []
    for first, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):

        def whole(k: int, end: int = end) -> int:
            while k < end and data[k] & 0xC0 == 0x80:  # a chunk ends with a character
                k += 1
            return k

        # The window of a hit lies in this text, so that its place does not depend on the text before.
        own = hits[np.searchsorted(hits, first + WINDOW) : np.searchsorted(hits, end)].tolist()
        cuts = [first]
        for hit in [*own, end]:
            while hit - cuts[-1] > CHUNK_MOST:
                cuts.append(whole(cuts[-1] + CHUNK_MOST))
            if (hit := whole(hit)) - cuts[-1] >= CHUNK_LEAST or hit == end > cuts[-1]:
                cuts.append(hit)
        out.append(cuts)
    return out


class ChunkCodec:
    """Encodes texts as the tokenizers library does with one of its files.

    Ids are held as strings with a character for each id, which are quick to join and small.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as f:
            self.by_chunks = cut_at_white_space(json.load(f))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size()
        if size > 0xD800:
            raise ValueError("ids are held in one UTF-16 unit each; this vocabulary has too many")
        self.decimal = [str(k) for k in range(size)]
        self.token = [self.tokenizer.id_to_token(k) or "" for k in range(size)]
        self.joined = self.tokenizer.decoder is None  # then decoding joins the tokens by blanks
        self.words, self.chunks = Bounded(CACHE_WORDS), Bounded(CACHE_CHUNK_BYTES)
        self.chunks_seen = self.chunks_encoded = self.joins_widened = 0

    @staticmethod
    def pieces(text: str) -> list[str]:
        """What is encoded independently in a text that begins and ends at white space or an end."""
        if _PLAIN.search(text):
            return _WORDS.findall(text)
        text = text.lower()
        return (_ASCII if text.isascii() else _LATIN).findall(text)

    def spans(self, texts: list[str]) -> list[str]:
        """The ids of texts that begin and end at white space or an end; new pieces are encoded in one batch."""
        split = [self.pieces(x) for x in texts]
        known: dict[str, str] = {}
        for piece in set().union(*split):
            if (ids := self.words.find(piece)) is None:
                known[piece] = ""
            else:
                known[piece] = ids
        new = [p for p, ids in known.items() if not ids]
        for piece, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            known[piece] = "".join(map(chr, e.ids))
        for piece, ids in known.items():
            if piece not in self.words:
                self.words.keep(piece, ids)
        return ["".join(map(known.__getitem__, x)) for x in split]

    def whole(self, text: str) -> str:
        """The ids of a text by the library alone."""
        return "".join(map(chr, self.tokenizer.encode(text, add_special_tokens=False).ids))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The ids of consecutive texts: shared chunks are encoded once, then the joins are repaired."""
        raw = data.tobytes()
        if not self.by_chunks:
            return [self.whole(raw[a:b].decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        texts = [[raw[a:b] for a, b in zip(c, c[1:], strict=False)] for c in cut_points(data, offsets)]
        have: dict[bytes, tuple] = {}
        new: list[bytes] = []
        for chunk in dict.fromkeys(c for t in texts for c in t):
            if (value := self.chunks.find(chunk)) is None:
                new.append(chunk)
            else:
                have[chunk] = value
        self.chunks_seen += sum(map(len, texts))
        self.chunks_encoded += len(new)
        split = []
        for chunk in new:
            text = chunk.decode()
            first = _BREAK.search(text)
            last = max(map(text.rfind, " \t\n\r"))
            # (ragged start, core, ragged end); without white space all of it is ragged
            split.append((text[: first.start()], text[first.start() : last + 1], text[last + 1 :]) if first else (text, None, ""))
        ids = iter(self.spans([core for _, core, _ in split if core is not None]))
        for chunk, (start, core, end) in zip(new, split, strict=True):
            have[chunk] = (start, core, end, None if core is None else next(ids))
            self.chunks.keep(chunk, have[chunk], 4 * len(chunk) + 400)
        joins, plans = [], []
        for t in texts:
            plan, ragged, left = [], "", ""
            for chunk in t:
                start, core, end, _ = have[chunk]
                ragged += start
                if core is None:
                    continue  # the window grows over this chunk
                plan += [len(joins), chunk]
                joins.append((left, ragged, core))
                ragged, left = end, core
            plans.append([*plan, len(joins)])
            joins.append((left, ragged, ""))
        repaired = self.repair(joins)
        out = []
        for t, plan in zip(texts, plans, strict=True):
            parts = [repaired[x] if isinstance(x, int) else have[x][3] for x in plan]
            out.append(self.whole(b"".join(t).decode()) if None in parts else "".join(parts))
        return out

    def repair(self, joins: list[tuple[str, str, str]]) -> list[str | None]:
        """The ids of what is between the cores of each join (left core, ragged text, right core); None if windows over
        all of both cores don't agree with the ids of the cores."""
        out: list[str | None] = [None] * len(joins)
        open_, words = range(len(joins)), 1
        while open_:
            sides = {k: (_last_words(joins[k][0], words), _first_words(joins[k][2], words)) for k in open_}
            windows = {k: (left, joins[k][1], right) for k, (left, right) in sides.items()}
            distinct = list(dict.fromkeys(windows.values()))
            known = dict(zip(dict.fromkeys(x for left, _, right in distinct for x in (left, right)), self.spans(list(dict.fromkeys(x for left, _, right in distinct for x in (left, right)))), strict=True))
            found = {}
            for window, e in zip(distinct, self.tokenizer.encode_batch_fast(list(map("".join, distinct)), add_special_tokens=False), strict=True):
                ids, left, right = "".join(map(chr, e.ids)), known[window[0]], known[window[2]]
                if len(ids) >= len(left) + len(right) and ids.startswith(left) and ids.endswith(right):
                    found[window] = ids[len(left) : len(ids) - len(right)]
            again = []
            for k in open_:
                if (ids := found.get(windows[k])) is not None:
                    out[k] = ids
                elif sides[k] != (joins[k][0], joins[k][2]):
                    again.append(k)
            self.joins_widened += len(again)
            open_, words = again, 4 * words
        return out

    @staticmethod
    def array(ids: str) -> np.ndarray:
        return np.frombuffer(ids.encode("utf-16-le"), np.uint16)

    def decode(self, ids: str) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        found = self.array(ids).tolist()
        return " ".join(map(self.token.__getitem__, found)) if self.joined else self.tokenizer.decode(found, skip_special_tokens=False)

    def spelled(self, ids: str) -> str:
        """Decimal ids joined by blanks."""
        return " ".join(map(self.decimal.__getitem__, self.array(ids).tolist()))


_codecs: dict[str, ChunkCodec] = {}


def codec(tokenizer_file: str) -> ChunkCodec:
    """One codec for each worker process, shared by all documents that it meets."""
    if tokenizer_file not in _codecs:
        _codecs.clear()
        _codecs[tokenizer_file] = ChunkCodec(tokenizer_file)
    return _codecs[tokenizer_file]


def _run(docs: DataFrame, tokenizer_file: str, id_col: str, text_col: str, columns: str, values) -> DataFrame:
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer_file)
        for batch in batches:
            for a, b, data, offsets in textkit.slices(batch.column(1)):
                yield values(coder, batch.column(0).slice(a, b - a), coder.encode(data, offsets))

    return source.mapInArrow(textkit.ending(run), f"doc_id {kind}, {columns}")


def encode(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids array<int>, decoded) of every row; a map without a shuffle."""

    def values(coder, keys, rows):
        ids = [coder.array(r).astype(np.int32) for r in rows]
        return pa.RecordBatch.from_arrays([keys, pa.array(map(len, rows), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(map(coder.decode, rows), pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return _run(docs, tokenizer_file, id_col, text_col, "n_tokens long, ids array<int>, decoded string", values)


def encode_digests(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of what :func:`encode` gives, made where it is made."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def values(coder, keys, rows):
        return pa.RecordBatch.from_arrays([keys, pa.array(map(len, rows), pa.int64()), pa.array(sha(coder.spelled(r)) for r in rows), pa.array(sha(coder.decode(r)) for r in rows)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _run(docs, tokenizer_file, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", values)


def decode(encoded: DataFrame, tokenizer_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) for rows of ids, by the library; a null list gives a null text."""
    source = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = codec(tokenizer_file).tokenizer
        for batch in batches:
            texts = [None if x is None else tokenizer.decode(x, skip_special_tokens=False) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return source.mapInArrow(run, f"doc_id {kind}, decoded string")
