"""The stages of one analysis, each computed once per application and input folder.

raw sales (written) -> tidy table (written) -> split rule (a few scalars) -> model (small effect tables)
-> scored hold-out pairs (written). Stage tables lie in the shared folder as parquet.
"""

from __future__ import annotations

import atexit
from functools import cached_property, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedonica import fixed_values as fixed
from hedonica import session
from hedonica.operators.boxplot import Boxes, boxes
from hedonica.operators.chain import fit_joined
from hedonica.operators.clean import first_clean, in_price_range, price_amount, tidy, with_log_price
from hedonica.operators.diagnose import judgement, pairs
from hedonica.operators.effects import EffectModel, fit_chain, predict
from hedonica.operators.split import Split, stratified_split
from hedonica.session import written
from hedonica.sources.surrogate import sales_raw

KEY, Y, PRED = "row_key", "logprice", "pred_price"
# Keys in text are most of what the sales tables hold; entropy coding halves them.
COMPACT = "zstd"
WIDE = ["land_area", "gross_area", "hood", "yr_built"]


def stage(build):
    """A stage that is built once; what it writes is the workspace's to delete."""

    def run(self):
        known = set(session.paths)
        out = build(self)
        self.owned += [p for p in session.paths if p not in known and p not in self.owned]
        return out

    return cached_property(wraps(build)(run))


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.owned: list[str] = []

    def path(self, name: str) -> str:
        """A place for files of this workspace."""
        self.owned.append(session.fresh_path(self.spark, name))
        return self.owned[-1]

    def close(self) -> None:
        """Delete what the stages and exports have written."""
        session.delete(self.spark, self.owned)
        self.owned = []

    @stage
    def raw(self) -> DataFrame:
        """The joins of the stand-in are done once, not by every query over it."""
        return written(sales_raw(self.spark, self.sf_dir), "raw", COMPACT)

    def clean(self) -> DataFrame:
        return first_clean(self.raw, [KEY])

    @stage
    def tidy(self) -> DataFrame:
        return written(tidy(self.raw, [KEY]), "tidy", COMPACT)

    @stage
    def boxes(self) -> Boxes:
        return boxes(self.tidy, Y, fixed.FACTORS, fixed.AXIS_LEVELS, KEY)

    @stage
    def split(self) -> Split:
        return stratified_split(
            self.tidy, Y, KEY, fixed.TRAIN_SHARE, fixed.SEED, fixed.STRATA
        )

    def train(self) -> DataFrame:
        return self.split.train(self.tidy)

    def holdout(self) -> DataFrame:
        return self.split.holdout(self.tidy)

    @stage
    def model(self) -> EffectModel:
        return fit_chain(self.train(), Y, fixed.FACTORS)

    def wide(self) -> DataFrame:
        """All sales with a price in range, with attributes of very many levels."""
        priced = self.raw.select(*WIDE, price_amount().alias("price"))
        return with_log_price(priced.where(in_price_range(F.col("price"))))

    @stage
    def wide_model(self) -> EffectModel:
        return fit_joined(self.wide(), Y, WIDE)

    def scored(self) -> DataFrame:
        return predict(self.holdout(), self.model, PRED)

    @stage
    def pairs(self) -> DataFrame:
        return written(pairs(self.scored(), Y, PRED, [KEY]), "pairs")

    @stage
    def judgement(self) -> DataFrame:
        return judgement(self.pairs, "price", Y, PRED, *fixed.SCATTER_LIMITS)

    def standard_errors(self) -> tuple[float, float]:
        return tuple(self.judgement.select("se1", "se2").first())


_open: dict[tuple, Workspace] = {}
TABLES = ["region", "nation", "customer", "orders", "part", "lineitem"]


def state_of(spark: SparkSession, sf_dir: str) -> tuple:
    """Size and time of change of the input tables."""
    found = []
    for name in TABLES:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        status = files.getFileStatus(at)
        for part in files.listStatus(at) if status.isDirectory() else [status]:
            found.append((name, part.getPath().getName(), part.getLen(), part.getModificationTime()))
    return tuple(found)


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The workspace of this application and these tables; stages are shared by all queries.

    Another folder, or tables that have changed, close it and begin a new one.
    """
    at = (spark.sparkContext.applicationId, sf_dir, state_of(spark, sf_dir))
    if at not in _open:
        close_workspaces(spark.sparkContext.applicationId)
        _open[at] = Workspace(spark, sf_dir)
    return _open[at]


def close_workspaces(application: str | None = None) -> None:
    """Delete what open workspaces have written, while their application runs."""
    for at, w in list(_open.items()):
        if w.spark.sparkContext._jsc is not None and application in (None, at[0]):
            w.close()
        del _open[at]


atexit.register(close_workspaces)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round named columns; adding zero turns a negative zero into a plain one."""
    return df.withColumns({c: F.round(c, d) + F.lit(0.0) for c, d in digits.items()})
