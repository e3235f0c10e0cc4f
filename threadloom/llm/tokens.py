"""Lengths in tokens of a public tokenizer."""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files, and the file used; both are parameters of every operator that counts tokens.
FOLDER = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
#: Words whose length a worker remembers before it starts afresh.
MEMO = 500_000


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


class Counter:
    """Counts tokens. A byte-level BPE cuts a text at single blanks, so that lengths of words with their blank add up; texts
    with other blanks are encoded whole."""

    def __init__(self, path: str):
        self.path, self.memo = path, {}

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in _tokenizer(self.path).encode_batch(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str | None]) -> list[int]:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        cut, whole = {}, {}
        for i, t in enumerate(texts):
            if not t:
                continue
            if "  " in t or t[0] == " " or t[-1] == " ":
                whole[i] = t
            else:
                first, *rest = t.split(" ")
                cut[i] = (first, rest)
        words = list({w for _, rest in cut.values() for w in rest if w not in memo})
        memo.update(zip(words, self._encode([" " + w for w in words])))
        out = [0] * len(texts)
        for (i, (_, rest)), n in zip(cut.items(), self._encode([first for first, _ in cut.values()])):
            out[i] = n + sum(map(memo.__getitem__, rest))
        for i, n in zip(whole, self._encode(list(whole.values()))):
            out[i] = n
        return out


def with_tokens(df: DataFrame, keep: list[str], text: str = "text", *, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns of keep and n_tokens, the length of text; 0 for null and empty texts."""
    path = f"{folder}/{vocabulary}"

    def count(batches):
        import pyarrow as pa

        counter = Counter(path)
        for b in batches:
            n = counter(b.column("__text").to_pylist())
            cols = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int32())], [*keep, "n_tokens"])

    rows = df.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__text")
    return rows.mapInArrow(count, schema + ", n_tokens int")
