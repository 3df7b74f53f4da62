"""SentencePiece BPE encoding by a prefix table of last tokens.

For each prefix of a text, the last token of its encoding is unique. A token that
ends at position i, found by an automaton over the vocabulary, is that last token
when it is compatible with the last token of the prefix it leaves: encoding the
two tokens' joined text gives just these two. The table is filled in one pass from
left to right, and the ids are read from it backwards. Nothing is merged in the
text itself, and the work is linear in its length.

A pair test suffices: merges inside two neighbouring tokens don't depend on
anything outside them while no merge crosses their outer borders, so a first
merge across a border in the whole text would be one in the pair alone as well.

Pieces never join a space to a preceding other character, nor hold a line break,
so texts split there into units that are encoded for themselves; a bounded cache
keeps the ids of units met before. Both facts are read off the model when it is
loaded; for a model without them the whole text is one unit.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from framelake.llm.common import bounded_batches, documents, lean, strings

#: Fixed value: the character that stands for a space in pieces.
SPACE = "▁"
#: Units and pair tests kept at most by a worker.
UNITS, PAIRS = 300_000, 1_000_000


class PrefixEncoder:
    """Ids and texts of a SentencePiece BPE model with identity normalisation."""

    def __init__(self, path: str) -> None:
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = m.serialized_model_proto()
        if b"\x0a\x08identity" not in spec:
            raise ValueError("only models with identity normalisation are encoded here")
        ordinary = [i for i in range(m.vocab_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.ids = {m.id_to_piece(i): i for i in ordinary}
        self.score = {i: m.get_score(i) for i in ordinary}
        self.size = {i: len(p) for p, i in self.ids.items()}
        self.text = {i: p for p, i in self.ids.items()}
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): i for i in range(m.vocab_size()) if m.is_byte(i)}
        self.unknown = m.unk_id()
        #: Merge types: which two tokens, wherever a piece divides into two, make a third, and its score.
        self.merge = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    self.merge[a, b] = (-self.score[i], i)
        self.automaton = ahocorasick.Automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        for p, i in self.ids.items():
            if self.alone(i):
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        single = {p for p in self.ids if len(p) == 1}
        if any(c not in single for p in self.ids for c in p):
            raise ValueError("a piece has a character that is no piece")
        self.strange = re.compile("([^" + re.escape("".join(sorted(single))) + "])")
        inner = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.unit = re.compile(r"(?s).+" if inner or any("\n" in p for p in self.ids) else r"\n+| *[^ \n]+| +")
        self.cache: dict[str, bytes] = {}
        self.ends = np.array([m.bos_id()], "<u4").tobytes(), np.array([m.eos_id()], "<u4").tobytes()

    def merged(self, symbols: list[int], border: int) -> bool:
        """Whether merging the symbols, best score first and leftmost among ties, never crosses the border (in symbols)."""
        merge = self.merge
        while len(symbols) > 1:
            best, where = None, -1
            for k in range(len(symbols) - 1):
                found = merge.get((symbols[k], symbols[k + 1]))
                if found and (best is None or found[0] < best[0]):
                    best, where = found, k
            if best is None:
                break
            if where == border - 1:
                return False
            symbols[where : where + 2] = [best[1]]
            border -= where < border
        self.left = symbols
        return True

    def alone(self, token: int) -> bool:
        """Whether the token's own text is encoded as the token."""
        return self.merged([self.ids[c] for c in self.text[token] if c in self.ids], -1) and self.left == [token]

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            x, y = self.text[a], self.text[b]
            known = self.merged([self.ids[c] for c in x + y], len(x))
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def tokens(self, text: str) -> list[int]:
        """Ids of a text of known characters, by its prefix table."""
        last: list[int | None] = [None] * (len(text) + 1)
        for end, (token, size) in self.automaton.iter(text):
            if last[end + 1] is None:
                start = end + 1 - size
                if not start or ((before := last[start]) is not None and self.compatible(before, token)):
                    last[end + 1] = token
        out, i = [], len(text)
        while i:
            out.append(last[i])
            i -= self.size[last[i]]
        return out[::-1]

    def encode_unit(self, unit: str) -> bytes:
        out: list[int] = []
        for part in self.strange.split(unit.replace(" ", SPACE)):
            if part and self.strange.fullmatch(part):
                raw = [self.bytes.get(x) for x in part.encode()]
                out += [self.unknown] if None in raw else raw
            elif part:
                out += self.tokens(part)
        return np.array(out, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids, begin and end included, as little-endian unsigned 32-bit integers."""
        if not text:
            return b"".join(self.ends)
        parts = [self.ends[0]]
        cache = self.cache
        for unit in self.unit.findall(" " + text.replace(SPACE, " ")):
            ids = cache.get(unit)
            if ids is None:
                ids = self.encode_unit(unit)
                if len(unit) < 64:
                    if len(cache) >= UNITS:
                        cache.clear()
                    cache[unit] = ids
            parts.append(ids)
        parts.append(self.ends[1])
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        return self.model.decode(np.frombuffer(ids, "<u4").tolist())


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    """One per worker and file."""
    return PrefixEncoder(path)


def sentencepiece_roundtrip(df: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` and, if wanted, ``ids`` and ``decoded`` of every text.

    Null texts count as empty: begin and end ids alone, decoded to an empty text.
    Rows are independent: repeated rows and null ids each give a row. Other
    columns are ignored. Unknown characters become byte pieces, or the unknown
    id for a model without them.
    """
    bounded_batches(df.sparkSession)
    kind = df.schema[id_column].dataType.simpleString()
    extra = ", ids array<int>, decoded string" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for b in batches:
            ids = [own.encode(t) for t in strings(b.column(1))]
            decoded = [own.decode(i) for i in ids]
            columns = [
                b.column(0),
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
            ]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.record_batch(columns, names)

    wanted = df.selectExpr(f"`{id_column}` AS id", f"CAST(`{text_column}` AS string) AS text")
    return wanted.mapInArrow(lean(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents``, encoded and decoded."""
    import public_tokenizers

    return sentencepiece_roundtrip(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")
