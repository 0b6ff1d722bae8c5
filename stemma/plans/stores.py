"""Small stores beside the data: prompts with versions, people by name, and answers that were given before."""

from __future__ import annotations

import hashlib
import re
import string
import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions.ocr import normalize_line_text
from stemma.operators.relations import latest_versions
from stemma.plans import jsons
from stemma.tables import settle

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
PROMPTS = "name string, version int, purpose string, body string, variables array<string>, response_schema string, tags array<string>"
PEOPLE = "name string, notes string"


@dataclass(frozen=True)
class Store:
    """A table in a folder; rows are only ever added."""

    spark: SparkSession
    path: str
    schema: str

    def rows(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(self.schema).parquet(self.path) if there else self.spark.createDataFrame([], self.schema)

    def add(self, row: tuple) -> None:
        self.spark.createDataFrame([row], self.schema).coalesce(1).write.mode("append").parquet(self.path)


def placeholders(body: str) -> set[str]:
    """The names that a text asks for as $name or ${name}; $$ is a dollar sign. A placeholder without a name is an error."""
    found = set()
    for m in string.Template.pattern.finditer(body):
        if m.group("invalid") is not None:
            raise ValueError("PROMPT_INVALID: a placeholder has no name")
        found |= {n for n in (m.group("named"), m.group("braced")) if n}
    return found


def save_prompt(store: Store, name: str, purpose: str, body: str, variables: list[str], response_schema: dict | None = None, tags: list[str] | None = None) -> int:
    """Adds the next version of a prompt, whose declared variables must be the ones in its text, and gives its number."""
    if bad := [v for v in variables if not _NAME.fullmatch(v)]:
        raise ValueError(f"PROMPT_VARIABLE_INVALID: {bad}")
    if placeholders(body) != set(variables):
        raise ValueError(f"PROMPT_VARIABLE_MISMATCH: declared {sorted(variables)}, used {sorted(placeholders(body))}")
    version = (store.rows().where(F.col("name") == name).agg(F.max("version")).first()[0] or 0) + 1
    store.add((name, version, purpose, body, sorted(variables), None if response_schema is None else jsons.canonical(response_schema), sorted(tags or [])))
    return version


def list_prompts(store: Store) -> DataFrame:
    """The newest version of each prompt, by name."""
    return latest_versions(store.rows(), "name", "version").orderBy("name")


def get_prompt(store: Store, name: str, version: int | None = None) -> dict:
    rows = store.rows().where(F.col("name") == name)
    found = (rows.where(F.col("version") == version) if version else rows.orderBy(F.desc("version"))).limit(1).collect()
    if not found:
        raise KeyError(f"PROMPT_NOT_FOUND: {name}")
    return found[0].asDict()


def render_prompt(store: Store, name: str, values: dict[str, str], version: int | None = None) -> str:
    """The text of a prompt with exactly its variables filled in."""
    prompt = get_prompt(store, name, version)
    if set(values) != set(prompt["variables"]):
        raise ValueError(f"PROMPT_RENDER_VARIABLES: {sorted(set(values) ^ set(prompt['variables']))}")
    return string.Template(prompt["body"]).substitute(values)


def add_person(store: Store, name: str, notes: str = "") -> None:
    if not name.strip():
        raise ValueError("a person needs a name")
    if not store.rows().where(F.lower("name") == name.strip().lower()).isEmpty():
        raise ValueError(f"{name} is known already")
    store.add((name.strip(), notes))


def list_people(store: Store) -> DataFrame:
    return store.rows().orderBy(F.lower("name"), "name")


class AnswerCache:
    """Answers by the hash of their request: each is asked for once, kept for `seconds`, the least used ones leave first."""

    def __init__(self, seconds: float, most: int = 1000, clock: Callable[[], float] = time.monotonic) -> None:
        self.seconds, self.most, self.clock = seconds, most, clock
        self.kept: OrderedDict[str, tuple[float, object]] = OrderedDict()
        self.running: dict[str, threading.Event] = {}
        self.lock = threading.Lock()

    def get(self, request: object, ask: Callable[[], object]) -> object:
        """The kept answer, or that of `ask`; calls with one request at the same time wait for the first. Errors are not kept."""
        key = hashlib.sha256(jsons.canonical(request).encode()).hexdigest()
        while True:
            with self.lock:
                if key in self.kept and self.clock() - self.kept[key][0] < self.seconds:
                    self.kept.move_to_end(key)
                    return self.kept[key][1]
                waiting = self.running.get(key)
                if waiting is None:
                    mine = self.running[key] = threading.Event()
                    break
            waiting.wait()
        try:
            answer = ask()
            with self.lock:
                self.kept[key] = (self.clock(), answer)
                self.kept.move_to_end(key)
                while len(self.kept) > self.most:
                    self.kept.popitem(last=False)
            return answer
        finally:
            with self.lock:
                del self.running[key]
            mine.set()


def distinct_answers(requests: DataFrame, request: str, ask: Callable[[str], str], kept: DataFrame | None = None) -> DataFrame:
    """(request..., answer): each different request is asked once, by the executors; kept has (key, answer) of former ones."""
    keyed = requests.withColumn("key", F.sha2(F.col(request), 256))
    new = keyed.select("key", F.col(request).alias("text")).where("key is not null").dropDuplicates(["key"])
    if kept is not None:
        new = new.join(kept.select("key"), "key", "left_anti")

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"key": b["key"], "answer": [ask(t) for t in b["text"]]})

    answers = settle(new.mapInPandas(run, "key string, answer string"))
    every = answers if kept is None else answers.unionByName(kept.select("key", "answer"))
    return keyed.join(every, "key", "left").drop("key")


def extract(text: str, ask: Callable[[str, dict], str], schema: dict) -> object:
    """What a model reads in a recognized text: the text is normalized, the answer must fit the schema."""
    return jsons.validated(ask(normalize_line_text(text) or "", schema), schema)


class Subscription:
    """Events of a log for one reader, at most `most` waiting; a reader that falls behind is cut off and must read again from its cursor."""

    def __init__(self, most: int = 64) -> None:
        self.most, self.events, self.expired = most, [], False
        self.ready = threading.Condition()

    def put(self, event: object) -> None:
        with self.ready:
            if not self.expired and len(self.events) >= self.most:
                self.events, self.expired = [], True
            elif not self.expired:
                self.events.append(event)
            self.ready.notify_all()

    def take(self, seconds: float = 0.0) -> object:
        """The next event, None if there is none in time; ValueError once the reader was cut off."""
        with self.ready:
            if not self.events and not self.expired:
                self.ready.wait(seconds)
            if self.expired:
                raise ValueError("the cursor has expired")
            return self.events.pop(0) if self.events else None


class Hub:
    """Hands events on to the readers there are, at most `most`."""

    def __init__(self, most: int = 32) -> None:
        self.most, self.readers = most, []

    def subscribe(self, waiting: int = 64) -> Subscription:
        self.readers = [r for r in self.readers if not r.expired]
        if len(self.readers) >= self.most:
            raise ValueError("too many readers")
        self.readers.append(Subscription(waiting))
        return self.readers[-1]

    def publish(self, event: object) -> None:
        for r in self.readers:
            r.put(event)
