"""Token counts without token identifiers, by heap-and-linked-list byte-pair merging.

The symbols of a text form a doubly linked list.  A heap holds every adjacent pair that the vocabulary can merge, keyed
by (rank, position); the lowest is popped again and again, the two symbols become one, and the pairs with its new
neighbours are pushed.  Each merge removes one symbol, so the count is *initial symbols - merges*; a final symbol that
the vocabulary lacks costs one token for each of its UTF-8 bytes.

No merge can join two characters that stand side by side in no piece of the vocabulary, so a text falls into segments
that merge independently of each other.  The rules for cutting are computed from the vocabulary when it is loaded, and
the count of a segment is kept in a cache of bounded size, since segments (words, mostly) recur across documents.

Cases: a null or empty text has 0 bytes and 0 tokens; very long texts and segments are counted whole; repeated rows
give repeated results; extra columns are ignored; an empty table gives an empty result.  A model with a normaliser,
without a mark before the text, without bytes for unknown characters, of another type than BPE or with pieces that a
user has defined is refused when it is loaded, since its counts would be wrong.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyward.llm import textkit

#: Segments whose counts a worker keeps; the older half is forgotten beyond.
CACHE_SEGMENTS = 600_000

#: The character that stands for a space in the vocabulary.
MARK = "▁"
#: Character ranges of the runs that make most segments.
LATIN = "A-Za-z0-9À-ÖØ-öø-ɏ"


class PieceCounter(dict):
    """Counts the tokens of texts for a SentencePiece BPE model; as a dict it is the cache segment -> tokens."""

    def __init__(self, model_file: str, cache_segments: int = CACHE_SEGMENTS):
        import sentencepiece

        super().__init__()
        self._refuse_others(model_file)
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        # With spaces instead of marks an ASCII text stays one byte a character.
        self.rank: dict[str, int] = {model.id_to_piece(i).replace(MARK, " "): int(-model.get_score(i)) for i in plain}
        self.limit = cache_segments
        self.older: dict[str, int] = {}
        self.cut = self._cutter(self.rank)

    @staticmethod
    def _refuse_others(model_file: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as messages

        with open(model_file, "rb") as f:
            model = messages.ModelProto.FromString(f.read())
        normal, trained = model.normalizer_spec, model.trainer_spec
        against = {
            "a normaliser": bool(normal.precompiled_charsmap or normal.normalization_rule_tsv),
            "no mark before the text": not normal.add_dummy_prefix or trained.treat_whitespace_as_suffix,
            "spaces that are removed or kept": normal.remove_extra_whitespaces or not normal.escape_whitespaces,
            "another type than BPE": trained.model_type != trained.BPE,
            "no bytes for unknown characters": not trained.byte_fallback,
            "pieces that a user has defined": any(p.type == p.USER_DEFINED for p in model.pieces),
        }
        if found := [k for k, v in against.items() if v]:
            raise ValueError(f"token counts can't be made for a model with {', '.join(found)}")

    @staticmethod
    def _cutter(pieces) -> re.Pattern:
        """A pattern whose matches cover any text and between which no piece has a pair of characters.

        A segment is a line end; or spaces and a run of Latin letters and digits, if what follows the run follows such
        a character in no piece; or else spaces and all up to the next space or line end.  A vocabulary with pieces
        that reach over a space or a line end gets whole texts as segments.
        """
        pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False)}
        if any(b == " " and a != " " or "\n" in a + b for a, b in pairs):
            return re.compile(r"(?s).+")
        run = re.compile(f"[{LATIN}]")
        joined = {b for a, b in pairs if run.match(a)}
        ends = "".join(re.escape(c) for c in map(chr, range(33, 127)) if c not in joined)
        return re.compile(rf"\n| *[{LATIN}]++(?![^{ends} \n])| *[^ \n]+| +")

    def __missing__(self, segment: str) -> int:
        if (n := self.older.get(segment)) is None:
            n = self.merge(segment)
        if len(self) >= self.limit // 2:
            self.older = dict(self)
            self.clear()
        self[segment] = n
        return n

    def merge(self, segment: str) -> int:
        """Tokens of a segment: its characters less the merges made, and more for characters spelled in bytes."""
        rank, n = self.rank.get, len(segment)
        if n == 1:
            return 1 if rank(segment) is not None else len(segment.encode())
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        # The rank of the pair that begins at each symbol; what the heap holds of a pair that has changed is stale.
        pair = [rank(segment[k : k + 2], -1) for k in range(n - 1)]
        pair.append(-1)
        heap = [r * n + k for k, r in enumerate(pair) if r >= 0]
        heapify(heap)
        symbols = n
        while heap:
            r, left = divmod(heappop(heap), n)
            if pair[left] != r:
                continue
            right = after[left]
            size[left] = length = size[left] + size[right]
            size[right], pair[right] = 0, -1
            symbols -= 1
            following = after[left] = after[right]
            r = -1
            if following < n:
                before[following] = left
                if (r := rank(segment[left : left + length + size[following]], -1)) >= 0:
                    heappush(heap, r * n + left)
            pair[left] = r
            if (previous := before[left]) >= 0:
                pair[previous] = r = rank(segment[previous : left + length], -1)
                if r >= 0:
                    heappush(heap, r * n + previous)
        if len(segment.encode()) > n:
            symbols += sum(len(c.encode()) - 1 for k, c in enumerate(segment) if size[k] == 1 and c > "\x7f" and rank(c) is None)
        return symbols

    def count(self, text: str | None) -> int:
        """Tokens of a text as the model's own library gives them, without begin and end."""
        if not text:
            return 0
        return sum(map(self.__getitem__, self.cut.findall(" " + text.replace(MARK, " "))))


_counters: dict[tuple, PieceCounter] = {}


def counter(model_file: str, cache_segments: int = CACHE_SEGMENTS) -> PieceCounter:
    """One counter for each worker process: its cache serves all tasks that the worker runs."""
    key = (model_file, cache_segments)
    if key not in _counters:
        _counters.clear()
        _counters[key] = PieceCounter(*key)
    return _counters[key]


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", token_limit: int = 4096, cache_segments: int = CACHE_SEGMENTS) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row; a map without a shuffle."""
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(model_file, cache_segments)
        for batch in batches:
            texts = batch.column(1)
            n = [tokens.count(x.as_py()) for x in texts]
            size = [len(x.as_buffer()) if x.is_valid else 0 for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > token_limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return source.mapInArrow(textkit.ending(run), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
