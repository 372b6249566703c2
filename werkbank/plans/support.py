"""Ticket conversations, drafts, generation logs and translations.

Histories are rows, not arrays: a ticket may have any number of messages. Arrays appear only
where their length is fixed by the operator (the last three turns).
"""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from werkbank.functions.predicates import visible_messages
from werkbank.operators.keyed import latest_by
from werkbank.operators.ordered import HOT_ROWS, PIECES, global_rank, spread_join
from werkbank.operators.shaping import numbered_page

VERBATIM_TURNS = 8
EVENT_TYPES = ("first_draft", "reprompt")


# ---- messages ---------------------------------------------------------------------------

def explode_positions(tickets: DataFrame) -> DataFrame:
    """Message ids of each ticket with their 0-based position; a ticket without messages
    keeps one row with NULLs."""
    return tickets.select("ticket_id", F.posexplode_outer("message_ids").alias("position", "message_id"))


def ticket_conversation(positions: DataFrame, messages: DataFrame, hot_rows: int = HOT_ROWS,
                        pieces: int = PIECES) -> DataFrame:
    """Visible history of each ticket in position order.

    A ticket of which some message is not cached has no history: it gives one row with NULL
    position, role and text and ``complete`` false.
    """
    ids = positions.filter("message_id IS NOT NULL")
    cached = messages.select("ticket_id", "message_id", "role", "body", "visible")
    broken = (ids.join(cached.select("ticket_id", "message_id"), ["ticket_id", "message_id"], "left_anti")
              .select("ticket_id").distinct())
    found = ids.join(cached.filter("visible"), ["ticket_id", "message_id"]).select(
        "ticket_id", "position", "role", F.col("body").alias("text"))
    whole = spread_join(found, broken, ["ticket_id"], "position", "left_anti", hot_rows, pieces,
                        sizes_from=ids)
    return whole.withColumn("complete", F.lit(True)).unionByName(
        broken.withColumn("complete", F.lit(False)), allowMissingColumns=True)


def _last_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last ``n`` turns per conversation. Spark cuts each map task to ``n`` rows per key
    before the shuffle."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")


def conversation_context(turns: DataFrame, n: int = VERBATIM_TURNS, hot_rows: int = HOT_ROWS,
                         pieces: int = PIECES) -> DataFrame:
    """Turns ``(conv_id, turn, role, text)`` marked as ``recent`` (the last ``n``, verbatim) or
    ``older`` (to be summarised), with the line 'role: text'."""
    border = _last_turns(turns.select("conv_id", "turn"), n).groupBy("conv_id").agg(
        F.min("turn").alias("_first"))
    marked = spread_join(turns, border, ["conv_id"], "turn", "inner", hot_rows, pieces)
    return marked.select("conv_id", "turn",
                         F.when(F.col("turn") >= F.col("_first"), "recent").otherwise("older").alias("part"),
                         F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("line"))


def _joined(condition: Column, separator: str) -> Column:
    turns = F.sort_array(F.collect_list(F.when(condition, F.struct("turn", "text"))))
    return F.array_join(F.transform(turns, lambda t: t["text"]), separator)


def retrieval_context(turns: DataFrame) -> DataFrame:
    """Search text of a chat: the user turns among the last three, joined by a blank."""
    return _last_turns(turns, 3).groupBy("conv_id").agg(
        _joined(F.col("role") == "user", " ").alias("context"))


def draft_query(turns: DataFrame) -> DataFrame:
    """Search text of a ticket draft: the last three customer turns joined by an empty line,
    or the last message when the customer wrote none."""
    texts = turns.filter(F.length("text") > 0)
    last = latest_by(texts.select("conv_id", "turn", "text"), ["conv_id"], ["turn"]).select(
        "conv_id", F.col("text").alias("_last"))
    asked = _last_turns(texts.filter(F.col("role") == "user"), 3).groupBy("conv_id").agg(
        _joined(F.lit(True), "\n\n").alias("_asked"))
    return last.join(asked, "conv_id", "left").select("conv_id", F.coalesce("_asked", "_last").alias("query"))


def ticket_sync_status(positions: DataFrame, tickets: DataFrame, messages: DataFrame,
                       drafts: DataFrame, version: str) -> DataFrame:
    """Per remote ticket: last ids on both sides, whether the cache is current, how many
    messages are still to be fetched, and whether a draft of this prompt version is missing."""
    remote = positions.groupBy("ticket_id").agg(
        F.max_by("message_id", "position").alias("remote_last_message_id"))
    wanted = (positions.filter("message_id IS NOT NULL")
              .join(messages.select("ticket_id", "message_id"), ["ticket_id", "message_id"], "left_anti")
              .groupBy("ticket_id").agg(F.count("*").alias("_fetch")))
    drafted = (drafts.filter(F.col("prompt_version") == version)
               .select("ticket_id", F.col("based_on_message_id").alias("remote_last_message_id"))
               .distinct().withColumn("_drafted", F.lit(True)))
    known = tickets.select("ticket_id", F.col("last_message_id").alias("cached_last_message_id"))
    last = F.col("remote_last_message_id")
    return (remote.join(known, "ticket_id", "left").join(wanted, "ticket_id", "left")
            .join(drafted, ["ticket_id", "remote_last_message_id"], "left")
            .select("ticket_id", last, "cached_last_message_id",
                    F.coalesce(F.col("cached_last_message_id") == last, F.lit(False)).alias("is_current"),
                    F.coalesce("_fetch", F.lit(0)).alias("messages_to_fetch"),
                    (last.isNotNull() & F.col("_drafted").isNull()).alias("draft_missing")))


def sync_summary(status: DataFrame) -> DataFrame:
    """One row of run counters."""
    times = lambda c: F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0))
    return status.agg(F.count("*").alias("tickets"), times("is_current").alias("was_current"),
                      times("messages_to_fetch").alias("messages_to_fetch"),
                      times("draft_missing").alias("drafts_to_generate"),
                      F.coalesce(F.sum((F.col("messages_to_fetch") > 0).cast("bigint")), F.lit(0))
                      .alias("incomplete_tickets"))


# ---- generation logs and drafts ------------------------------------------------------------

def rejected_events(events: DataFrame) -> DataFrame:
    """Events of an unknown type."""
    return events.filter(F.col("event_type").isNull() | ~F.col("event_type").isin(*EVENT_TYPES))


def append_generation_log(logs: DataFrame, events: DataFrame) -> DataFrame:
    """The rows to append for new events: every reprompt, and a first draft only where its
    (ticket, revision) has none, neither stored nor earlier in the batch. A row points to the
    first draft of its revision; ids come with the events."""
    revision = ["ticket_id", "based_on_message_id"]
    known = events.filter(F.col("event_type").isin(*EVENT_TYPES)).drop("first_draft_id")
    stored = logs.filter("event_type = 'first_draft'").select(*revision, F.col("id").alias("first_draft_id"))
    fresh = latest_by(known.filter("event_type = 'first_draft'"), revision, ["created_at", "id"], first=True)
    fresh = fresh.join(stored, revision, "left_anti")
    firsts = stored.unionByName(fresh.select(*revision, F.col("id").alias("first_draft_id")))
    reprompts = known.filter("event_type = 'reprompt'")
    # A reprompt that comes before the first draft of its batch has nothing to point to yet.
    linked = (reprompts.join(firsts, revision, "left")
              .withColumn("first_draft_id", F.when(F.col("first_draft_id") < F.col("id"), F.col("first_draft_id"))))
    return linked.unionByName(fresh.withColumn("first_draft_id", F.lit(None).cast("bigint")))


def evolve(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """The columns of a newer schema; missing ones get their default."""
    defaults = defaults or {}
    present = set(df.columns)
    return df.select([
        (F.col(f.name) if f.name in present else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name)
        for f in schema.fields])


def rebuild_logs(legacy: DataFrame, schema: T.StructType) -> DataFrame:
    """Logs without ids in the current schema: ids by time, reprompts linked to the first
    draft of their revision. Both sides of that join are plain shuffles, so the adaptive planner can split a
    revision of very many reprompts."""
    revision = ["ticket_id", "based_on_message_id"]
    numbered = global_rank(legacy, "created_at", revision + ["event_type", "response_text"])
    numbered = numbered.withColumnRenamed("rank", "id")
    first = latest_by(numbered.filter("event_type = 'first_draft'").select(*revision, "id"), revision, ["id"],
                      first=True).withColumnRenamed("id", "_first")
    linked = numbered.join(first, revision, "left").withColumn(
        "first_draft_id", F.when(F.col("event_type") == "reprompt", F.col("_first"))).drop("_first")
    return evolve(linked, schema, {"prompt_version": ""})


def read_reprompts(logs: DataFrame) -> DataFrame:
    return logs.filter("event_type = 'reprompt'").orderBy(F.desc("created_at"), F.desc("id"))


def search_reprompts(logs: DataFrame, ticket_id: str | None = None, search: str | None = None,
                     date_from: date | None = None, date_to: date | None = None) -> DataFrame:
    """Reprompts of a ticket, of days (inclusive), with a text in any of four columns."""
    found = logs.filter("event_type = 'reprompt'")
    if ticket_id:
        found = found.filter(F.col("ticket_id") == str(ticket_id))
    day = F.col("created_at").cast("date")
    if date_from:
        found = found.filter(day >= F.lit(date_from))
    if date_to:
        found = found.filter(day <= F.lit(date_to))
    if search:
        text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in
                                  ("instructions", "input_response_text", "response_text", "messages_json")])
        found = found.filter(F.lower(text).contains(search.lower()))
    return found


def reprompt_history(logs: DataFrame, page: int = 1, page_size: int = 25, **filters) -> DataFrame:
    """One page of matching reprompts, newest first, with row and page counts."""
    return numbered_page(search_reprompts(logs, **filters), [F.desc("created_at"), F.desc("id")],
                         page, page_size).select(
        "id", "ticket_id", "created_at", "instructions", "first_draft_id", "row_count", "page_count")


def reprompt_totals(logs: DataFrame) -> DataFrame:
    return logs.filter("event_type = 'reprompt'").agg(
        F.count("*").alias("reprompts"), F.countDistinct("ticket_id").alias("tickets"))


def recent_logs(logs: DataFrame, ticket_id: str | None = None, limit: int | None = None) -> DataFrame:
    """One ticket oldest first, or all newest first; with ``limit`` the first ones."""
    if ticket_id is not None:
        found = logs.filter(F.col("ticket_id") == ticket_id).orderBy("created_at", "id")
    else:
        found = logs.orderBy(F.desc("created_at"), F.desc("id"))
    return found if limit is None else found.limit(limit)


def first_draft(logs: DataFrame) -> DataFrame:
    """The first draft of each ticket."""
    return latest_by(logs.filter("event_type = 'first_draft'"), ["ticket_id"], ["created_at", "id"], first=True)


def current_drafts(drafts: DataFrame, logs: DataFrame, version: str) -> DataFrame:
    """Drafts of the current prompt version with reply and sources. A stored draft is an
    object or a bare text; its own sources win even when empty, else those of the newest
    first-draft log of the revision count."""
    revision = ["ticket_id", "based_on_message_id"]
    stored = F.col("response_json")
    is_object = stored.startswith("{")
    bare = F.get_json_object(F.concat(F.lit('{"v":'), stored, F.lit("}")), "$.v")
    has_sources = is_object & F.coalesce(F.array_contains(F.json_object_keys(stored), "sources"), F.lit(False))
    own = F.from_json(F.get_json_object(stored, "$.sources"), "array<string>")
    logged = latest_by(logs.filter("event_type = 'first_draft'").select(*revision, "id", "created_at", "sources"),
                       revision, ["created_at", "id"]).select(*revision, F.col("sources").alias("_logged"))
    none = F.array().cast("array<string>")
    return (drafts.filter(F.col("prompt_version") == version).join(logged, revision, "left")
            .select(*revision,
                    F.when(is_object, F.coalesce(F.get_json_object(stored, "$.reply"), F.lit("")))
                    .otherwise(bare).alias("reply"),
                    F.when(has_sources, F.coalesce(own, none)).otherwise(F.coalesce("_logged", none))
                    .alias("sources")))


def merge_sources(df: DataFrame, retrieved: str, searched: str, own: str) -> DataFrame:
    """Source ids of a draft: retrieved first, then searched, each once, blanks and the own
    ticket left out."""
    both = F.filter(F.concat(retrieved, searched), lambda s: s.isNotNull() & (s != ""))
    return df.withColumn("sources", F.array_remove(F.array_distinct(both), F.col(own)))


# ---- translations ------------------------------------------------------------------------------

# Characters whose JSON escape other writers spell with capital hex digits.
_CAPITAL_ESCAPES = "[\\x0b\\x0e\\x0f\\x1a-\\x1f]"


def _json_text(text: Column) -> Column:
    whole = F.to_json(F.struct(text.alias("t")))
    usual = F.substring(whole, F.lit(6), F.length(whole) - 6)
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        character = chr(code)
        escaped = F.replace(escaped, F.lit(character), F.lit(json.dumps(character)[1:-1]))
    rare = F.concat(F.lit('"'), escaped, F.lit('"'))
    return F.when(text.rlike(_CAPITAL_ESCAPES), rare).otherwise(usual)


def translation_key(text: Column, settings: dict) -> Column:
    """sha256 of the JSON of the text and the generation settings with sorted names."""
    mark = "\u0000"
    before, after = json.dumps({**settings, "text": mark}, sort_keys=True, ensure_ascii=False).split(
        json.dumps(mark))
    return F.sha2(F.concat(F.lit(before), _json_text(text), F.lit(after)), 256)


def translation_backlog(messages: DataFrame, cache: DataFrame, settings: dict) -> DataFrame:
    """Each distinct non-blank text with its key, how many messages carry it, and whether its
    translation is cached. Equal texts are one row before they meet the cache."""
    texts = (messages.filter(F.trim(F.regexp_replace("body", r"\s", " ")) != "")
             .groupBy(F.col("body").alias("text")).agg(F.count("*").alias("messages"))
             .withColumn("cache_key", translation_key(F.col("text"), settings)))
    known = cache.select("cache_key").distinct().withColumn("_hit", F.lit(True))
    return texts.join(known, "cache_key", "left").select(
        "cache_key", "text", "messages", F.coalesce("_hit", F.lit(False)).alias("cached"))


def translated_messages(messages: DataFrame, cache: DataFrame, settings: dict) -> DataFrame:
    """Messages with their cached translation; blank texts pass through, others without one
    stay NULL. One text may be on very many messages: the adaptive planner splits that key on
    the left side of the join."""
    blank = F.trim(F.regexp_replace("body", r"\s", " ")) == ""
    key = F.when(~blank, translation_key(F.col("body"), settings))
    known = cache.select("cache_key", "translated_text")
    return (messages.withColumn("cache_key", key).join(known, "cache_key", "left")
            .withColumn("translated", F.when(blank, F.col("body")).otherwise(F.col("translated_text")))
            .drop("translated_text", "cache_key"))


def visible_turns(messages: DataFrame) -> DataFrame:
    """Visible messages with text as chat turns."""
    return messages.filter(visible_messages()).select(
        F.col("ticket_id").alias("conv_id"), F.col("position").alias("turn"),
        F.when(F.col("role") == "Customer", "user").otherwise("assistant").alias("role"),
        F.col("body").alias("text"))
