"""Folders of test tables without rows, and of rows of nulls and odd values beside real ones, with extra columns."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

FOLDER = "/root/testdata/sf0.001"


def make(folder: Path, kind: str) -> str:
    folder.mkdir()
    for p in Path(FOLDER).glob("*.parquet"):
        t = pq.read_table(p)
        if kind == "empty":
            t = t.slice(0, 0)
        elif p.stem not in ("pack_sizes", "mix_targets", "subjects"):
            few = t.slice(0, 60)
            nulls = pa.table({f.name: pa.nulls(3, f.type) for f in t.schema}, schema=t.schema)
            # every row twice, rows of nulls, and columns whose names operators use inside
            t = pa.concat_tables([few, nulls, few])
            for extra in ("pair", "node", "rank", "masked", "component", "n"):
                if extra not in t.column_names:
                    t = t.append_column(extra, pa.array(["x"] * len(t)))
        pq.write_table(t, folder / p.name)
    return str(folder)
