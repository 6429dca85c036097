"""What an experiment has finished, kept beside its scored rows, so that a run that stopped can go on."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobcast.sources.versions import Versions


def digest(*values: object) -> str:
    return hashlib.md5(repr([str(v) for v in values]).encode()).hexdigest()


class Ledger:
    """Finished (group, variant) pairs below ``root``, separate for each value of ``settings``.

    Rows are written first; then one empty file, named after group, variant and folder, says that they are whole. A run that
    stops between the two leaves rows that nobody reads. Entries are never changed, so runs may also go on side by side.
    """

    def __init__(self, spark: SparkSession, root: str, settings: Sequence[object] = ()) -> None:
        self.spark, self.marks = spark, Versions(spark, f"{root.rstrip('/')}/{digest(*settings)}")

    def entries(self) -> dict[tuple[str, str], str]:
        """Folders of finished (group digest, variant) pairs."""
        parts = [name.split(".") for name in self.marks.published()]
        return {(p[0], p[1]): p[2] for p in parts if len(p) == 3}

    def finish(self, group: tuple, variants: Sequence[str], rows: DataFrame) -> None:
        """Write the scored rows of a group's variants, then note these as finished."""
        folder = f"rows-{uuid.uuid4().hex}"
        rows.write.parquet(self.marks.folder(folder))
        for v in variants:
            self.marks.publish(f"{digest(*group)}.{v}.{folder}")

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that later runs must share with the first, such as centres: made once."""
        done = [n.split(".")[1] for n in self.marks.published() if n.startswith(name + ".")]
        if not done:
            folder = f"rows-{uuid.uuid4().hex}"
            make().write.parquet(self.marks.folder(folder))
            self.marks.publish(f"{name}.{folder}")
            done = [folder]
        return self.spark.read.parquet(self.marks.folder(min(done)))

    def scored(self, wanted: dict[tuple, Sequence[str]], rows_of: Callable[[tuple, Sequence[str]], DataFrame],
               schema: StructType, threads: int) -> DataFrame:
        """Rows of all ``wanted`` groups and variants: those in the ledger as they are, the others from ``rows_of``."""
        if not wanted:
            raise ValueError("no group has enough rows for a model")
        done = self.entries()
        open_ = {g: [v for v in own if (digest(*g), v) not in done] for g, own in wanted.items()}

        def one(group: tuple) -> None:
            self.finish(group, open_[group], rows_of(group, open_[group]))

        with ThreadPoolExecutor(threads) as pool:
            list(pool.map(one, [g for g, own in open_.items() if own]))
        done = self.entries()
        by_folder: dict[str, list[str]] = {}
        for g, own in wanted.items():
            for v in own:
                by_folder.setdefault(done[digest(*g), v], []).append(v)
        # folders with the same variants are read together
        sets: dict[tuple, list[str]] = {}
        for folder, own in by_folder.items():
            sets.setdefault(tuple(sorted(own)), []).append(self.marks.folder(folder))
        frames = [self.spark.read.schema(schema).parquet(*folders).where(F.col("model").isin(*own)) for own, folders in sets.items()]
        return reduce(DataFrame.unionByName, frames)
