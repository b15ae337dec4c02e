"""Learner state when answers come late: a tree of spans of days for each key.

``refresh_partials`` takes later answers only and ``keep_state`` counts a late
answer when it arrives. Here the state is that of the batch fold whatever the
order of arrival. The log is kept by day. A leaf is the fold of a key's answers
of one day, a node composes its up to 16 children in order of time, and the
root is the state. A late answer re-folds its key's day from the log of that
day; the spans above that hold a touched day are composed of their children
again, and those with one child take its content. Other days of the log are not
read, and only the spans that hold a touched day are written again, all of them
in one step. Nodes also give the state before any day, from at most 15 spans of
each level.
"""

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from recallgrid.operators.performance import KEY, ORDER, answer_partials, merge_partials, partial_schema, performance_from_partials
from recallgrid.sources.cell_table import CellTable, joined_on
from recallgrid.sources.storage import stored

#: Children of a node: two to this power.
BITS = 4
#: Levels above the days; 65,536 days, 1880 to 2059. Earlier and later answers lie on the first and the last of them.
LEVELS = 4
_EPOCH = 1 << (BITS * LEVELS - 1)
_LAST = (1 << (BITS * LEVELS)) - 1
_SPAN = [*KEY, "span"]


def _day() -> Column:
    """Answers without a time come before all others, as in the batch fold."""
    day = F.unix_date(F.to_date("answered_at")) + F.lit(_EPOCH)
    return F.least(F.greatest(F.coalesce(day, F.lit(0)), F.lit(0)), F.lit(_LAST)).cast("int")


class AnswerTree:
    """The log and the tree below one folder; ``schema`` gives the types of the answers' columns."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        fields = [T.StructField(c, schema[c].dataType) for c in [*KEY, *ORDER, "is_correct"]]
        span = T.StructField("span", T.IntegerType())
        self.spark = spark
        self.log = CellTable(spark, f"{path}/log", T.StructType([*fields, span]))
        empty = spark.createDataFrame([], self.log.schema)
        self.nodes = CellTable(spark, f"{path}/nodes", partial_schema(empty, _SPAN))

    def add(self, answers: DataFrame, batch: int, stream: str) -> list[str]:
        """Answers of any days; returns the spans written again (level-span). Each batch counts once.

        The log takes the batch first. A writer lost between the two steps
        leaves a tree without it, and the same batch folds it in from the log.
        """
        if self.nodes.manifest().batch >= batch:
            return []
        rows = answers.select(*KEY, *ORDER, F.coalesce("is_correct", F.lit(False)).alias("is_correct"))
        rows = stored(rows.withColumn("span", _day()), "arrived")
        spans = sorted(r[0] for r in rows.select("span").distinct().collect())
        self.log.append(rows, F.col("span"), batch, stream)

        now = self.nodes.manifest()
        held, contents, touched = self.nodes.cells(now), [], []
        days = self.log.rows(cells=map(str, spans))
        folded = answer_partials(joined_on(days, rows.select(*_SPAN).distinct(), _SPAN, "left_semi"), _SPAN)
        fresh = stored(merge_partials(folded, key=_SPAN), "days")
        leaves = self.nodes.rows(now, [f"0-{s}" for s in spans])
        content, own = stored(joined_on(leaves, fresh, _SPAN, "left_anti").unionByName(fresh), "level-0"), 0
        for level in range(LEVELS + 1):
            cells = [f"{level}-{s}" for s in spans]
            touched += cells
            parents = sorted({s >> BITS for s in spans})
            around = {f"{level}-{s}" for p in parents for s in range(p << BITS, (p + 1) << BITS)} - set(cells)
            # Spans that are the only children have the content of those above: it is composed once, for all these levels.
            lone = len(parents) == len(spans) and not around & held.keys()
            if level < LEVELS and lone:
                spans = parents
                continue
            contents.append(content.withColumn("level", F.explode(F.sequence(F.lit(own), F.lit(level)))))
            contents[-1] = contents[-1].withColumn("span", F.expr(f"shiftright(span, {BITS} * (level - {own}))"))
            if level == LEVELS:
                break
            below = content.withColumn("span", F.shiftright("span", BITS * (level - own)).cast("int"))
            children = below.unionByName(self.nodes.rows(now, around & held.keys()))
            up = F.shiftright("span", BITS).cast("int")
            merged = merge_partials(children.withColumn("span", up), key=_SPAN).select(*self.nodes.schema.names)
            content, own, spans = stored(merged, f"level-{level + 1}"), level + 1, parents
        every = contents[0]
        for part in contents[1:]:
            every = every.unionByName(part)
        # The level is needed for the cell only.
        self._replace(every, touched, batch, stream)
        return touched

    def _replace(self, rows: DataFrame, touched: list[str], batch: int, stream: str) -> None:
        self.nodes.replace(rows, F.concat_ws("-", F.col("level").cast("string"), F.col("span").cast("string")), touched, batch, stream)

    def state(self, questions: DataFrame) -> DataFrame:
        """The performance table of all answers that have come."""
        return performance_from_partials(self.nodes.rows(cells=[f"{LEVELS}-0"]), questions)

    def state_before(self, day: datetime.date, questions: DataFrame) -> DataFrame:
        """The performance table of the answers before a day (midnight as answered_at has it), out of the tree."""
        end = min(max((day - datetime.date(1970, 1, 1)).days + _EPOCH, 0), _LAST)
        cells = []
        for level in range(LEVELS):
            at = end >> (BITS * level)
            cells += [f"{level}-{s}" for s in range(at >> BITS << BITS, at)]
        return performance_from_partials(self.nodes.rows(cells=cells), questions)


def keep_tree(answers: DataFrame, path: str, checkpoint: str, available_now: bool = True, interval: str = "10 minutes") -> StreamingQuery:
    """Start the stream that folds every micro-batch into the tree."""

    def store(batch: DataFrame, number: int) -> None:
        AnswerTree(batch.sparkSession, path, batch.schema).add(batch, number, checkpoint)

    writer = answers.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()
