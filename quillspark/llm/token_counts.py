"""Token counts by the whole-token shortcut.

Offline, once per worker, every vocabulary string that starts a word is encoded alone; those that come back as
one token form a table of proven whole tokens. A text is cut where no vocabulary string can reach across, each
piece found in the table counts as one token, and only the rest is merged by the library itself. Merged pieces
are remembered in a bounded memo, as words repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.piece_memo import PieceMemo, split_words

#: The character the library writes for a space.
SPACE = "▁"
#: Bytes of words remembered in a worker.
MEMO = 24 << 20
#: Characters after which a word is looked up again without its last one.
TAILS = ",.;:!?\n"


class PieceCounter:
    """Exact token counts for a sentencepiece BPE model whose normaliser changes nothing but spaces.

    A cut is exact where no vocabulary string holds the two characters beside it, in that order, as merges then
    never reach across. Before a space that follows another character this is proven for the whole model; before
    a final mark it is looked up for the letter in front. A model without these facts is counted by the library alone.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto.FromString(self.model.serialized_model_proto()).normalizer_spec
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: Without a table of rules the normaliser changes no character, alone or beside others.
        identity = not spec.precompiled_charsmap and not spec.normalization_rule_tsv and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
        self.cuttable = identity and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        words = [p[1:] for p in pieces if p.startswith(SPACE) and SPACE not in p[1:] and len(p) > 1]
        self.whole = {w for w, ids in zip(words, self.model.encode(words, num_threads=1)) if len(ids) == 1}
        #: Tokens of a mark that no merge joins to what stands before it.
        self.tails = {c: len(self.model.encode("a" + c)) - 1 for c in TAILS if "a" + c not in self.joined}
        self.memo = PieceMemo(self._merge, sorted(self.whole), MEMO)

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of tokens of each word, as if a space stood before it."""
        counts: dict[str, int] = {}
        cut = []
        for w in words:
            base, extra = w, 0
            while len(base) > 1 and base[-1] in self.tails and base[-2:] not in self.joined:
                extra += self.tails[base[-1]]
                base = base[:-1]
            cut.append((base, extra))
        rest = [b for b in dict.fromkeys(b for b, _ in cut) if b not in self.whole]
        counts.update(zip(rest, map(len, self.model.encode(rest, num_threads=1))))
        return np.empty(0, np.uint32), np.array([counts.get(b, 1) + n for b, n in cut], np.int64)

    def count(self, text: str | None) -> int:
        """Tokens of a whole text by the library alone."""
        return len(self.model.encode(text, num_threads=1)) if text else 0

    def count_all(self, texts: pa.Array) -> np.ndarray:
        """Tokens of whole texts; null and empty texts have none."""
        out = np.zeros(len(texts), np.int64)
        texts = pc.fill_null(texts, "")
        if not self.cuttable:
            odd = np.ones(len(texts), bool)
        else:  # runs of spaces, spaces at an end and the space's own sign are left to the library
            odd = np.asarray(pc.match_substring_regex(texts, f"^ | $|  |{SPACE}").to_numpy(zero_copy_only=False))
        for i in np.flatnonzero(odd):
            out[i] = self.count(texts[i].as_py())
        plain = np.flatnonzero(~odd & np.asarray(pc.not_equal(texts, "").to_numpy(zero_copy_only=False)))
        if len(plain):
            codes, n_words, words = split_words(texts.take(pa.array(plain)))
            per_word = self.memo.lens[slots] if len(slots := self.memo.slots(words)) else np.empty(0, np.int64)
            out[plain] = np.add.reduceat(per_word[codes], np.cumsum(n_words) - n_words)
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    """One counter per worker and model."""
    return PieceCounter(path)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add n_bytes, n_tokens and over_limit for each row; one row out for each row in.

    Null and empty texts have 0 bytes and 0 tokens. Null ids, repeated rows and very long texts are counted like any
    others; further columns are ignored, whatever their names. An empty table gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b[0], b[1], pa.array(tokens.count_all(b[2]))], ["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    return (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), n_bytes.alias("n_bytes"), F.col(text_col).alias("text"))
        .mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
