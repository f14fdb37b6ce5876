"""Service surfaces: dictionary and thesaurus commands (THS-7, DICT-2), corpus lifecycle and jobs (IDX-11), path safety (TXT-24)."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import lexicon, stats
from strandloom.sources import store
from strandloom.streaming.ingest import Store

ENTRIES = "term_id string, corpus_id string, entity string, canonical string, aliases array<string>, category string, frequency long, confidence double"
RELATIONS = "relation_id string, corpus_id string, source string, target string, relation_type string, weight double, bidirectional boolean"
KINDS = ("synonym", "hypernym", "hyponym", "related")


class Dictionary:
    """Dictionary entries as an immutable table; every change gives a new one."""

    def __init__(self, entries: DataFrame):
        self.entries = entries

    def add(self, new: DataFrame) -> Dictionary:
        return Dictionary(store.upsert(self.entries, new.select(self.entries.columns), ["term_id"]))

    def lookup(self, term: str) -> DataFrame:
        k = term.strip().lower()
        return self.entries.filter((F.lower("canonical") == k) | F.exists("aliases", lambda a: F.lower(a) == k)).orderBy(F.col("frequency").desc(), "term_id")

    def stats(self) -> DataFrame:
        return stats.dictionary_stats(self.entries)

    def export(self) -> DataFrame:
        return store.to_json_rows(self.entries)

    def load(self, rows: DataFrame) -> Dictionary:
        return self.add(store.from_json_rows(rows, ENTRIES).filter("term_id is not null"))


class Thesaurus:
    """Thesaurus relations; hypernyms may not form a cycle."""

    def __init__(self, relations: DataFrame):
        self.relations = relations

    def add(self, new: DataFrame, check: bool = True) -> Thesaurus:
        out = Thesaurus(store.upsert(self.relations, new.filter(F.col("relation_type").isin(*KINDS)).select(self.relations.columns), ["relation_id"]))
        if check and lexicon.has_cycle(out.relations):
            raise ValueError("hypernyms would form a cycle")
        return out

    def search(self, term: str) -> DataFrame:
        return lexicon.relations_of(self.relations, term)

    def stats(self) -> DataFrame:
        return stats.thesaurus_stats(self.relations)

    def export(self) -> DataFrame:
        return store.to_json_rows(self.relations)

    def load(self, rows: DataFrame) -> Thesaurus:
        return self.add(store.from_json_rows(rows, RELATIONS).filter("relation_id is not null"))


class Corpora:
    """Corpora, their tables (with a corpus_id column) and jobs, in a versioned store."""

    CORPORA, JOBS = "corpus_id string, name string", "job_id string, corpus_id string, status string"

    def __init__(self, tables: Store):
        self.store = tables

    def _next(self, table: str, df: DataFrame) -> None:
        self.store.write(table, df, max(self.store.versions(table), default=0) + 1)

    def list(self) -> DataFrame:
        return self.store.read("corpora", self.CORPORA).orderBy("corpus_id")

    def jobs(self) -> DataFrame:
        return self.store.read("jobs", self.JOBS)

    def create(self, corpus_id: str, name: str) -> None:
        new = self.store.spark.createDataFrame([(corpus_id, name)], self.CORPORA)
        self._next("corpora", store.upsert(self.store.read("corpora", self.CORPORA), new, ["corpus_id"]))

    def start_job(self, job_id: str, corpus_id: str, status: str = "running") -> None:
        new = self.store.spark.createDataFrame([(job_id, corpus_id, status)], self.JOBS)
        self._next("jobs", store.upsert(self.jobs(), new, ["job_id"]))

    def delete(self, corpus_id: str, tables: dict[str, str] | None = None) -> dict[str, int]:
        """Removes a corpus and its rows in ``tables`` (name -> schema), cancels its running jobs; rows removed by table."""
        gone = {}
        for name, schema in {"corpora": self.CORPORA, **(tables or {})}.items():
            df = self.store.read(name, schema)
            gone[name] = df.filter(F.col("corpus_id") == corpus_id).count()
            self._next(name, df.filter(F.col("corpus_id") != corpus_id))
        stop = (F.col("corpus_id") == corpus_id) & (F.col("status") == "running")
        self._next("jobs", self.jobs().withColumn("status", F.when(stop, "cancelled").otherwise(F.col("status"))))
        return gone


def confined(root: str, path: str) -> str:
    """The path below ``root``; an error if it would leave it."""
    parts = PurePosixPath(path)
    if parts.is_absolute() or ".." in parts.parts or "\x00" in path:
        raise ValueError("the path leaves its root")
    return f"{root.rstrip('/')}/{parts}"
