"""Whether a message asks for the search engine.

A message asks if a clause holds a trigger without a denial within 24 characters,
or a known file or folder name; a session that was switched on needs neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clauses, nfkc

NEAR = 24
MIN_NAME = 3
#: Names, or first grams of names, that are broadcast at most.
FEW_NAMES = 100_000

# Trigger words, signs of denial, signs that a sync is wanted.
TRIGGERS = ("知识库", "资料库", "公司资料", "公司资料库", "公司知识库", "用知识库", "查知识库", "查一下资料", "查一下文档", "查一下文件", "翻一下资料", "/kb")
DENIAL = r"(?:不要|不用|不需要|无需|无须|禁止|关闭|停用|停掉|别再|别用|不使用|不涉及|不包含|不含|无关|不查|不查询|不检索|不搜索|不搜|不看|不引用|no\b|don't|dont|do not|without|disable)"
SYNC = r"(?:同步|更新.{0,4}索引|重建.{0,4}索引|刷新.{0,4}索引|重新.{0,4}索引|索引.{0,4}(?:更新|重建|刷新|同步)|索引一下|sync|reindex|rebuild)"


def last_turn_text(events: DataFrame) -> DataFrame:
    """session_id and the user's text after the last start of a turn.  events: session_id, idx, type, source, text."""
    start = events.groupBy("session_id").agg(F.coalesce(F.max(F.when(F.col("type") == "turn/start", F.col("idx"))), F.lit(-1)).alias("start"))
    said = events.join(start, "session_id").where((F.col("idx") > F.col("start")) & (F.col("type") == "user/message") & (F.col("source") == "user") & F.col("text").isNotNull())
    parts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return said.groupBy("session_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def has_trigger(text: Column, triggers=TRIGGERS) -> Column:
    """Some clause holds a trigger that isn't denied nearby."""

    def hit(clause: Column) -> Column:
        out = F.lit(False)
        for t in triggers:
            at = F.instr(clause, t.lower())
            around = F.substr(clause, F.greatest(F.lit(1), at - NEAR), F.lit(len(t) + NEAR) + F.least(F.lit(NEAR), at - 1))
            out = out | ((at > 0) & ~around.rlike(f"(?iu){DENIAL}"))
        return out

    return F.exists(clauses(text), hit)


def wants_sync(text: Column) -> Column:
    return F.exists(clauses(text), lambda c: c.rlike(f"(?iu){SYNC}") & ~c.rlike(f"(?iu){DENIAL}"))


def path_names(docs: DataFrame) -> DataFrame:
    """Folded names of files and parts of folders, 3 characters or longer."""
    parts = F.array_union(F.array("name"), F.split("dir", "/"))
    return docs.select(F.explode(parts).alias("n")).select(F.lower(nfkc(F.col("n"))).alias("name")).where(F.length("name") >= MIN_NAME).distinct()


def named_paths(messages: DataFrame, names: DataFrame, key: str = "session_id") -> DataFrame:
    """key and name for each known name in a clause of the message.  Wherever a clause has the first three characters of some
    names, what follows is looked up among all names, once for each length that these names have.  Names are counted first:
    few are broadcast, of more the same joins shuffle.  Clauses never are broadcast, whatever Spark takes their size for."""
    gram = F.substring("name", 1, MIN_NAME)
    names = names.where(F.length("name") >= MIN_NAME).select("name").distinct()
    known = names.agg(F.count("*").alias("n"), F.count_distinct(gram).alias("grams"), F.max(F.length("name")).alias("longest")).first()
    starts = names.groupBy(gram.alias("gram")).agg(F.collect_set(F.length("name")).alias("lengths"))
    starts = F.broadcast(starts) if known["grams"] <= FEW_NAMES else starts.hint("merge")
    names = F.broadcast(names) if known["n"] <= FEW_NAMES else names.hint("merge")
    clause = messages.select(key, F.explode(F.array_distinct(clauses(F.col("text")))).alias("clause")).where(F.length("clause") >= MIN_NAME)
    parts = F.transform(F.sequence(F.lit(1), F.length("clause") - (MIN_NAME - 1)), lambda i: F.substring("clause", i, F.lit(known["longest"] or 0)))
    rows = clause.select(key, F.explode(F.array_distinct(parts)).alias("part")).withColumn("gram", F.substring("part", 1, MIN_NAME))
    tries = rows.join(starts, "gram").select(key, "part", F.explode("lengths").alias("n")).where(F.length("part") >= F.col("n"))
    return tries.select(key, F.substring("part", F.lit(1), F.col("n")).alias("name")).join(names, "name", "left_semi").select(key, "name").distinct()


def evaluate(messages: DataFrame, names: DataFrame, sessions: DataFrame, triggers=TRIGGERS, explicit_only: bool = True) -> DataFrame:
    """session_id, allowed, sync and asked (whether the message itself asks) for each message.  sessions: session_id, enabled."""
    named = named_paths(messages, names).select("session_id").distinct().withColumn("named", F.lit(True))
    out = messages.join(named, "session_id", "left").join(sessions.select("session_id", "enabled"), "session_id", "left")
    asked = F.coalesce(has_trigger(F.col("text"), triggers), F.lit(False)) | F.coalesce("named", F.lit(False))
    allowed = F.lit(not explicit_only) | F.coalesce("enabled", F.lit(False)) | asked
    return out.select("session_id", allowed.alias("allowed"), (allowed & wants_sync(F.col("text"))).alias("sync"), asked.alias("asked"))
