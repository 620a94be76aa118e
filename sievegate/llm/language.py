"""Language identification by compression.

Each language has a zstandard raw-content dictionary: whole learned texts of
that language, a mix in the order of their hashes. A text is encoded with each dictionary and goes
to the language with the smallest result; narrow margins are rejected. Long
texts are encoded in blocks, so that every block leans on the dictionary and
not on what came before it in the text, and sizes add up over the whole text.
Both sides are lower-case letters with one blank for all that parts words.
Equal sizes, and those one byte apart in short texts, are decided by the letters: by the mean log frequency of the text's
character pairs in the learned texts.

Bounds: ``dict_bytes`` of text a language, ``sample`` texts a language.
Defined cases: texts that are null or hold no letter are ``und`` with score 0;
without any learned language all are; rows are independent of each other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import bounded_sample
from .store import bounded_batches, free_name
from .texts import tidied

DICT_BYTES = 96 << 10
SAMPLE = 400
BLOCK = 4096
LEVEL = 9
#: Share by which the second best must be larger, else the answer is rejected.
MARGIN = 0.01
_LETTER = regex.compile(r"\p{L}")
_REST = regex.compile(r"[^\p{L}]+")


def letters(text: str) -> str:
    """What the encoder sees: lower-case letters, with one blank for all that stands between."""
    return _REST.sub(" ", text.lower())


def _whole_texts(texts: list[str], most: int) -> bytes:
    """Whole texts, in the order given, as far as they fit into ``most`` bytes; those that do not are passed over, unless none fits."""
    out, size = [], 0
    for raw in (x.encode() + b"\n" for x in texts):
        if size + len(raw) <= most:
            out.append(raw)
            size += len(raw)
    return b"".join(out) if out else min((x.encode() for x in texts), key=len, default=b"")


class LanguageModel:
    def __init__(self, texts: dict[str, list[str]], dict_bytes: int = DICT_BYTES, level: int = LEVEL) -> None:
        self.level = level
        self.raw, pairs = {}, {}
        for lang in sorted(texts):
            clean = [x for x in map(letters, texts[lang]) if x.strip()]
            raw = _whole_texts(clean, dict_bytes)
            if len(raw) >= 8:
                self.raw[lang] = raw
                pairs[lang] = sum((Counter(map("".join, zip(x, x[1:], strict=False))) for x in clean), Counter())
        self.pairs = {lang: {k: np.log((n + 0.5) / (sum(c.values()) + 1000)) for k, n in c.items()} for lang, c in pairs.items()}
        self.rare = {lang: np.log(0.5 / (sum(c.values()) + 1000)) for lang, c in pairs.items()}
        self._ready: dict[str, zstandard.ZstdCompressor] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": {}}

    def sizes(self, raw: bytes) -> list[int]:
        if not self._ready:
            for lang, content in self.raw.items():
                words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                words.precompute_compress(level=self.level)
                self._ready[lang] = zstandard.ZstdCompressor(dict_data=words, level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False)
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self._ready.values()]

    def _letters(self, text: str, lang: str) -> float:
        low, table, rare = text, self.pairs[lang], self.rare[lang]
        found = [table.get(low[i : i + 2], rare) for i in range(len(low) - 1)]
        return sum(found) / max(1, len(found))

    def predict(self, text: str | None, margin: float = MARGIN) -> tuple[str, float, bool]:
        """Language, score and whether a narrow margin rejects the answer."""
        if not self.raw or text is None or not _LETTER.search(text):
            return "und", 0.0, True
        text = letters(text)
        raw = text.encode()
        size = self.sizes(raw)
        least = min(size)
        langs = list(self.raw)
        best = [lang for lang, s in zip(langs, size, strict=True) if s <= least + (len(raw) < 200)]
        pick = best[0] if len(best) == 1 else max(best, key=lambda x: (self._letters(text, x), x))
        others = [s for lang, s in zip(langs, size, strict=True) if lang != pick]
        # 8 bits a byte would be the exact ratio; encoded sizes are far from ideal codes, so less counts
        score = 1.0 / (1.0 + sum(float(np.exp2(-min(60.0, max(0, s - least) * 0.5))) for s in others))
        return pick, score, bool(others) and min(others) < least * (1 + margin)


def _identify(model: LanguageModel, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py(), margin) for t in batch.column(batch.num_columns - 1)]
            more = [pa.array([f[0] for f in found], type=pa.string()), pa.array([f[1] for f in found], type=pa.float64()), pa.array([f[2] for f in found], type=pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    return tidied(run)


def fit_language(docs: DataFrame, learn, text: str = "text", lang: str = "lang", sample: int = SAMPLE, dict_bytes: int = DICT_BYTES) -> LanguageModel:
    rows = docs.where(learn).select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("g"))
    return LanguageModel(bounded_sample(rows, "g", "t", sample), dict_bytes)


def identify_language(docs: DataFrame, model: LanguageModel, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score and rejected; columns of these names in docs are replaced."""
    bounded_batches(docs.sparkSession)
    kept = docs.drop("lang_pred", "score", "rejected")
    schema = kept.schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return kept.withColumn(free_name(kept, "_scan"), F.col(text).cast("string")).mapInArrow(_identify(model, margin), schema)
