"""Search sessions: steps, selected results, relevant files, refined queries, summaries."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.errors import BadQuery, SessionNotFound


def sessionised(log: DataFrame, user: str, time: str, gap_seconds: int = 1800) -> DataFrame:
    """Adds session_no: a new session after a gap of more than ``gap_seconds`` (times are epoch seconds)."""
    w = Window.partitionBy(user).orderBy(time)
    new = (F.col(time) - F.lag(time).over(w) > gap_seconds).cast("int")
    return log.withColumn("session_no", F.sum(F.coalesce(new, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def steps(log: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """Adds step_number from 1 and whether the step is the session's last."""
    w = Window.partitionBy(*keys).orderBy(time, tie)
    back = Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(tie))
    return log.withColumn("step_number", F.row_number().over(w).cast("long")).withColumn("is_last", F.row_number().over(back) == 1)


def relevant_files(results: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, file_path, score): the sum of the selected results' scores."""
    return results.filter("selected").groupBy(session, "file_path").agg(F.sum("score").alias("score"))


def refined_query(step_rows: DataFrame, files: DataFrame, session: str = "session_id", best: int = 3) -> DataFrame:
    """(session, refined): the last query, in its most relevant files where there are any."""
    last = step_rows.groupBy(session).agg(F.max_by("query_text", "step_number").alias("query_text"))
    w = Window.partitionBy(session).orderBy(F.desc("score"), "file_path")
    few = files.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= best)
    named = few.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "file_path"))), lambda x: x["file_path"]), " OR ").alias("in_files"))
    refined = F.when(F.col("in_files").isNull(), F.col("query_text")).otherwise(F.concat("query_text", F.lit(" in "), "in_files"))
    return last.join(named, session, "left").select(session, refined.alias("refined"))


def summary(step_rows: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, steps, queries, first query, last query)."""
    return step_rows.groupBy(session).agg(F.count("*").alias("steps"), F.count_distinct("query_text").alias("queries"), F.min_by("query_text", "step_number").alias("first_query"), F.max_by("query_text", "step_number").alias("last_query"))


def with_selection(results: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Results with ``selected`` set where their keys are chosen."""
    marks = chosen.select(*keys).distinct().withColumn("_s", F.lit(True))
    base = results if "selected" in results.columns else results.withColumn("selected", F.lit(False))
    return base.join(marks, keys, "left").withColumn("selected", F.coalesce("_s", "selected")).drop("_s")


def history(step_rows: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, queries): the queries of each session in order."""
    inside = F.transform(F.array_sort(F.collect_list(F.struct("step_number", "query_text"))), lambda x: x["query_text"])
    return step_rows.groupBy(session).agg(inside.alias("queries"))


STEPS = "session_id string, step_number long, query_text string, at long"
RESULTS = "session_id string, step_number long, id long, file_path string, score double, selected boolean, notes string"


class Sessions:
    """Search sessions kept by a caller: steps, their results, what was selected and noted.

    A session is one user's doing and small; ``tables`` gives all of them as DataFrames for the operators above.
    """

    def __init__(self):
        self._held: dict[str, dict] = {}

    def create(self, name: str | None = None) -> str:
        key = name or uuid.uuid4().hex
        if key in self._held:
            raise BadQuery(f"session {key} is there already")
        self._held[key] = {"steps": [], "results": {}}
        return key

    def get(self, session: str) -> dict:
        if session not in self._held:
            raise SessionNotFound(session)
        return self._held[session]

    def names(self) -> list[str]:
        return sorted(self._held)

    def delete(self, session: str) -> None:
        self.get(session)
        del self._held[session]

    def add_step(self, session: str, query: str, results: list[dict], at: int | None = None) -> int:
        """Add a query and its results (id, file_path, score); gives the step's number from 1."""
        own = self.get(session)
        number = len(own["steps"]) + 1
        own["steps"].append((query, int(time.time()) if at is None else at))
        own["results"][number] = [{"id": r["id"], "file_path": r["file_path"], "score": float(r["score"]), "selected": False, "notes": None} for r in results]
        return number

    def _result(self, session: str, step: int, result: int) -> dict:
        for r in self.get(session)["results"].get(step, ()):
            if r["id"] == result:
                return r
        raise BadQuery(f"step {step} has no result {result}")

    def select(self, session: str, step: int, result: int, selected: bool = True) -> None:
        self._result(session, step, result)["selected"] = selected

    def note(self, session: str, step: int, result: int, text: str) -> None:
        self._result(session, step, result)["notes"] = text

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(steps, results) of all sessions."""
        steps_ = [(k, i + 1, q, at) for k, s in self._held.items() for i, (q, at) in enumerate(s["steps"])]
        results = [(k, n, r["id"], r["file_path"], r["score"], r["selected"], r["notes"]) for k, s in self._held.items() for n, rs in s["results"].items() for r in rs]
        return spark.createDataFrame(steps_, STEPS), spark.createDataFrame(results, RESULTS)

    def refined(self, session: str, best: int = 3) -> str:
        """The last query, in the files whose selected results score most."""
        own = self.get(session)
        if not own["steps"]:
            raise BadQuery(f"session {session} has no query")
        files: dict[str, float] = {}
        for rs in own["results"].values():
            for r in rs:
                if r["selected"]:
                    files[r["file_path"]] = files.get(r["file_path"], 0.0) + r["score"]
        named = sorted(files, key=lambda f: (-files[f], f))[:best]
        last = own["steps"][-1][0]
        return f"{last} in {' OR '.join(named)}" if named else last

    def search(self, session: str, find: Callable[[str], list[dict]], query: str, most: int = 3, keep: int = 1) -> list[dict]:
        """Search in steps: each takes up the query refined by the best results so far, until it brings nothing new."""
        seen: dict[int, dict] = {}
        for _ in range(max(1, most)):
            found = find(query)
            step = self.add_step(session, query, found)
            fresh = [r for r in found if r["id"] not in seen]
            seen |= {r["id"]: r for r in fresh}
            if not fresh:
                break
            for r in found[:keep]:
                self.select(session, step, r["id"])
            query = self.refined(session)
        return sorted(seen.values(), key=lambda r: (-float(r["score"]), r["id"]))
