"""Asking a model about the sections of forms within a budget of time: what comes too late or fails is a row with an error.

`ask` is a function from a prompt to an answer, such as a call of a service or of a local model; it runs in the executors. A
page's sections are asked a few at a time. A call that takes too long is given up, and with the page's time all that is left of
the page is, so that no page holds its task for longer than its budget.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.config import Settings, clamp
from inkgrid.functions import text as t
from inkgrid.functions.once import dealt
from inkgrid.operators import caches, clean, triage
from inkgrid.operators.rules import repaired_range

ANSWERS = "page_id {0}, section string, answer string, error string, timed_out boolean, duration_ms bigint"
# What a section's fields say that were given up with the page, or whose answer is no object of fields.
OUT_OF_TIME, UNREADABLE = "cleaner_total_budget_exceeded", "invalid_cleaner_response"
SLOW = "section_timeout"
ITEM = "struct<value:string,normalized_value:string,confidence:string,needs_review:boolean,reason:string>"
INSTRUCTION = (
    "You put recognised text of a scanned form right. For each field choose the value among its candidates, or correct them; "
    'answer with one JSON object {"fields": {"<id>": {"value": "", "normalized_value": "", "confidence": 0.0, "needs_review": false, "reason": ""}}}.\n'
)

FIELD_ANSWER = 'Read this field alone, not its neighbours; an empty field has empty values. Answer with one JSON object {"value": "", "normalized_value": "", "confidence": 0.0}.'
KIND_HINTS = {
    "numeric_text": "Give digits only; of several numbers the one that belongs to the field's name. ",
    "date_text": "Give the date, as YYYY-MM-DD if it can be read so, without its caption. ",
    "free_text": "Give what is written by hand in the languages it is in, without lines and captions that are printed. ",
    "signature_or_text": "Give the name that is signed; a signature that can't be read is SIGN_PRESENT. ",
}
ANY_KIND = "Give what was filled in, without the field's caption. "
RULE_HINTS = {
    "name_not_place": "It is a person's name or signature: no place, date, number or release statement. ",
    "exact_text": "It is one of few values; spellings of one value are the same. ",
    "contains_english": "The English part of the report is wanted; what is Chinese may be left out. ",
    "bilingual_text": "Both the Chinese and the English part of the report are wanted, without part numbers and captions. ",
}
TRIAGE_INSTRUCTION = (
    "You help a person who audits forms and has little time. From the issues below choose at most {} to show, the riskiest and those whose evidence is weakest first; "
    "merge repeated ones, change no verdict, and call a review_pending issue something to review, never a violation. "
    'Answer with one JSON object {{"problem_items": [{{"field_id": "", "kind": "failure or review", "text": ""}}], "reason": ""}} with ids from the list.\n'
)


@dataclass(frozen=True)
class Budget:
    """Seconds for a call and for a page, and how many calls of a page run at once; each within limits."""

    call_s: float = 75.0
    page_s: float = 90.0
    at_once: int = 3

    @property
    def call(self) -> float:
        return clamp(self.call_s, 0.05, 300.0)

    @property
    def page(self) -> float:
        return clamp(self.page_s, 0.05, 600.0)

    @property
    def calls(self) -> int:
        return int(clamp(self.at_once, 1, 8))


def _page(prompts: list[str], ask: Callable[[str], str], budget: Budget) -> list[tuple[str | None, str | None, bool, int]]:
    """(answer, error, timed out, milliseconds) of each prompt of a page.

    Calls run in daemon threads: Python can't end a call, but nothing waits for one that was given up.
    """
    todo, said, began = queue.SimpleQueue(), queue.SimpleQueue(), {}
    for k in range(len(prompts)):
        todo.put(k)
    open_, over = threading.Event(), time.monotonic() + budget.page
    open_.set()

    def work() -> None:
        while open_.is_set():
            try:
                k = todo.get_nowait()
            except queue.Empty:
                return
            began[k] = time.monotonic()
            try:
                said.put((k, ask(prompts[k]), None))
            except Exception as failed:  # noqa: BLE001
                said.put((k, None, f"{type(failed).__name__}: {failed}"))

    def start() -> None:
        threading.Thread(target=work, daemon=True).start()

    for _ in range(min(budget.calls, len(prompts))):
        start()
    made: dict[int, tuple[str | None, str | None, bool, int]] = {}
    spent = lambda k: int(1000 * (time.monotonic() - began[k])) if k in began else 0
    while len(made) < len(prompts) and (now := time.monotonic()) < over:
        running = [k for k in list(began) if k not in made]
        wait = min([over - now, 0.5, *[began[k] + budget.call - now for k in running]])
        try:
            k, answer, error = said.get(timeout=max(0.0, wait)) if wait > 0 else said.get_nowait()
            if k not in made:
                made[k] = (answer, error, False, spent(k))
        except queue.Empty:
            for k in running:
                if time.monotonic() - began[k] >= budget.call:
                    made[k] = (None, SLOW, True, spent(k))
                    start()  # in the place of the thread that is stuck
    open_.clear()
    return [made.get(k, (None, OUT_OF_TIME, True, spent(k))) for k in range(len(prompts))]


def asked(prompts: DataFrame, ask: Callable[[str], str], budget: Budget = Budget()) -> DataFrame:
    """page_id, section, answer, error, timed_out, duration_ms for every row (page_id, section, prompt).

    Pages are dealt out by their number; each is asked as a whole. Null prompts are asked as empty ones. What a task that is run
    again has asked before is asked again: keep answers with `through_cache`.
    """
    schema = ANSWERS.format(prompts.schema["page_id"].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]

    def page(rows: list[tuple]) -> pd.DataFrame:
        answers = _page([r[2] or "" for r in rows], ask, budget)
        return pd.DataFrame([(r[0], r[1], *a) for r, a in zip(rows, answers)], columns=names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for frame in frames:
            for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None):
                if held and row[0] != held[0][0]:
                    yield page(held)
                    held = []
                held.append(row)
        if held:
            yield page(held)

    rows = dealt(prompts.select("page_id", "section", "prompt"), "page_id").sortWithinPartitions("page_id", "section")
    return rows.mapInPandas(run, schema)


def prompts(rows: DataFrame, instruction: str = INSTRUCTION) -> DataFrame:
    """page_id, section, prompt from the rows of clean.local_clean: the instruction and the section's fields with their candidates as JSON."""
    return clean.requests(rows).select("page_id", "section", F.concat(F.lit(instruction), "payload").alias("prompt"))


def _rule() -> Column:
    """What a field's rule wants, in words, and the rule itself with its parameters."""
    low, high = (F.coalesce(F.col(f"params.{k}").cast("string"), F.lit("any")) for k in ("min", "max"))
    special = F.when(F.col("validator") == "int_range", F.concat(F.lit("It is a number from "), low, F.lit(" to "), high, F.lit(". "))).otherwise("")
    for name, hint in RULE_HINTS.items():
        special = F.when(F.col("validator") == name, F.lit(hint)).otherwise(special)
    return F.concat(special, F.lit("Rule: "), "validator", F.lit(" "), F.to_json("params"), F.lit(". "))


def field_prompts(checks: DataFrame) -> DataFrame:
    """Checks (field_id, label, recognizer, validator, params) with the prompt for a reading of the field's own image."""
    kind = F.lit(ANY_KIND)
    for name, hint in KIND_HINTS.items():
        kind = F.when(F.col("recognizer") == name, F.lit(hint)).otherwise(kind)
    return checks.withColumn("prompt", F.concat(F.lit("The image shows one field of a form: "), "label", F.lit(". "), kind, _rule(), F.lit(FIELD_ANSWER)))


def triage_prompts(checks: DataFrame, settings: Settings) -> DataFrame:
    """page_id, section, prompt: which few of a page's issues to show, as `asked` takes them. Pages without issues have none."""
    opening = TRIAGE_INSTRUCTION.format(settings.issues)
    return triage.requests(checks).select("page_id", F.lit("triage").alias("section"), F.concat(F.lit(opening), "payload").alias("prompt"))


def triage_items(answers: DataFrame) -> DataFrame:
    """page_id, pos, field_id, kind, text of the items in answers to triage_prompts, as triage.accepted_items takes them.

    An answer that failed or has no items gives no rows: the page keeps its ranking by rule.
    """
    body = F.from_json(t.json_inside(t.unfenced(F.col("answer"))), "problem_items array<struct<field_id:string,kind:string,text:string>>")
    rows = answers.filter("error is null").select("page_id", F.posexplode(body["problem_items"]).alias("pos", "i"))
    return rows.filter("i is not null").select("page_id", "pos", *[F.coalesce(F.col(f"i.{c}"), F.lit("")).alias(c) for c in ("field_id", "kind", "text")])


def triaged(checks: DataFrame, ask: Callable[[str], str], settings: Settings, budget: Budget = Budget()) -> DataFrame:
    """The issues shown for each page: those a model chose that are issues of the page, or by rule where it chose none."""
    return triage.chosen(triage_items(asked(triage_prompts(checks, settings), ask, budget)), checks, settings)


def cleaning_key(section: Column, provider: str, model: str, prompt: Column, version: str) -> Column:
    """The key of a section's answer: the section, who was asked, and what (fields, candidates and instruction are in the prompt)."""
    return caches.key(section, F.lit(provider), F.lit(model), prompt, F.lit(version))


def through_cache(wanted: DataFrame, cache: DataFrame, ask: Callable[[str], str], budget: Budget, settings: Settings, now: float, provider: str, model: str, version: str = "1") -> tuple[DataFrame, DataFrame]:
    """(answers as `asked` gives them with cache_hit and key, entries to be saved): only what the cache (key, answer, cached_at) lacks is asked.

    A cached timeout, an entry without an answer, is not asked again before it expires.
    """
    keyed = wanted.withColumn("key", cleaning_key(F.col("section"), provider, model, F.col("prompt"), version))
    known = caches.live(cache, now, settings)
    new = asked(caches.misses(keyed, known), ask, budget).join(keyed.select("page_id", "section", "key"), ["page_id", "section"])
    held = keyed.join(known.groupBy("key").agg(F.max("answer").alias("answer")), "key")
    late = F.col("answer").isNull()
    hits = held.select("page_id", "section", "answer", F.when(late, SLOW).alias("error"), late.alias("timed_out"), F.lit(0).cast("long").alias("duration_ms"), F.lit(True).alias("cache_hit"), "key")
    results = new.select("key", "answer", F.col("answer").alias("value"), F.lit(None).cast("string").alias("normalized_value"), "error", "timed_out")
    return new.withColumn("cache_hit", F.lit(False)).select(*hits.columns).unionByName(hits), caches.entries(results, now, settings)


def values(answers: DataFrame, rows: DataFrame) -> DataFrame:
    """page_id, field_id, value, normalized_value, confidence, needs_review, reason, error, as clean.overlay takes them.

    Fields of a section that failed, or whose answer is no object of fields, have an error; fields that the answer leaves out
    have no row and keep their local value.
    """
    body = t.json_inside(t.unfenced(F.col("answer")))
    inside = F.coalesce(F.from_json(body, f"struct<fields:map<string,{ITEM}>>")["fields"], F.from_json(body, f"map<string,{ITEM}>"))
    said = answers.select("page_id", "section", "error", inside.alias("__said"))
    said = said.withColumn("error", F.coalesce("error", F.when(F.col("__said").isNull(), UNREADABLE)))
    shown = rows.filter((F.col("recognizer") != "checkbox") & (F.size("cands") > 0)).select("page_id", "section", "field_id", "validator", "params")
    found = shown.join(said, ["page_id", "section"]).withColumn("__item", F.when(F.col("error").isNull(), F.col("__said")[F.col("field_id")]))
    found = found.filter(F.col("error").isNotNull() | F.col("__item").isNotNull())
    english = F.col("validator").isin("english_text", "contains_english")
    value = F.coalesce("__item.value", F.lit(""))
    normal = t.first_filled(F.col("__item.normalized_value"), F.col("__item.value"))
    return found.select(
        "page_id",
        "field_id",
        F.when(english, t.english_only(value)).otherwise(value).alias("value"),
        F.when(english, t.english_only(normal)).when(F.col("validator") == "int_range", repaired_range(normal)).otherwise(normal).alias("normalized_value"),
        F.coalesce(F.col("__item.confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
        F.coalesce("__item.needs_review", F.lit(False)).alias("needs_review"),
        F.coalesce("__item.reason", F.lit("")).alias("reason"),
        "error",
    )


def cleaner(ask: Callable[[str], str], budget: Budget = Budget()) -> Callable[[DataFrame], DataFrame]:
    """The hook for plans.inspection.inspect(cleaner=...)."""
    return lambda rows: values(asked(prompts(rows), ask, budget), rows)
