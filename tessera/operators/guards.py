"""Guards on the next step of a browser session: targets that its history rules out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Roles of fields that open a list of choices, roles of its entries, and names of such lists.
CHOOSER = ("textbox", "searchbox", "combobox")
ENTRY = ("option", "listitem", "gridcell")
LISTS = "(?i)chooser|listbox|dialog|menu|suggest|dropdown|picker"


def _has(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def chooser(role: Column, operations: Column) -> Column:
    """Is it a field to type in that opens a list of choices?"""
    return F.coalesce(role.isin(*CHOOSER) & F.array_contains(operations, "TYPE"), F.lit(False))


def transient(role: Column, within: Column) -> Column:
    """Is it an entry of a list that is open for now?"""
    return F.coalesce(role.isin(*ENTRY), F.lit(False)) | F.coalesce(within, F.lit("")).rlike(LISTS)


def allowed_targets(targets: DataFrame, history: DataFrame, window: int = 8) -> DataFrame:
    """targets (session, kind, index, role, within, operations, value) that the session's history leaves open.

    history (session, step, op, index, text, role, operations, action, page_changed), step unique in
    a session, kind being type, click or read.  Ruled out are

    * typing into what one of the last ``window`` steps typed into, if that changed nothing, was the
      last step, or its text stands there; and into any chooser, after typing into one that opened a list;
    * clicking on a chooser while a list is open after a click or typing, and on what one of the last
      steps found stale since the page last changed;
    * reading what was read since the page last changed, however long ago.

    The last steps come by a bounded rank, all else by aggregates a session, so no session's
    history is gathered.  A session without history keeps all; one without targets has none; a null
    op, index or text is none, and a null page_changed neither changes the page nor leaves it.
    """
    w = Window.partitionBy("session").orderBy(F.desc("step"))
    recent = history.withColumn("__back", F.row_number().over(w)).where(F.col("__back") <= window)
    changed = F.coalesce("page_changed", F.lit(False))
    pages = history.where(changed).groupBy("session").agg(F.max("step").alias("__page"))

    last = recent.where("__back = 1").select("session", F.col("op").alias("__op"), (chooser(F.coalesce("role", F.lit("")), F.coalesce("operations", F.array(F.lit("TYPE")))) | F.coalesce("action", F.lit("")).rlike("textbox|searchbox|combobox")).alias("__chose"))
    opened = targets.groupBy("session").agg(F.bool_or((F.col("kind") == "click") & transient(F.col("role"), F.col("within"))).alias("__open"))
    t = targets.join(opened, "session", "left").join(last, "session", "left")

    typed = recent.where((F.col("op") == "type") & _has("index"))
    dead = typed.groupBy("session", "index").agg(F.bool_or((F.col("__back") == 1) | F.coalesce(~F.col("page_changed"), F.lit(False))).alias("__dead"), F.collect_set(F.when(_has("text"), F.col("text"))).alias("__texts"))
    since = lambda rows, name: rows.join(pages, "session", "left").where(_has("index") & ~changed & (F.col("__page").isNull() | (F.col("step") > F.col("__page")))).select("session", "index", F.lit(True).alias(name)).distinct()
    stale, read = since(recent.where("op = 'stale'"), "__stale"), since(history.where("op = 'read'"), "__read")
    t = t.join(dead, ["session", "index"], "left").join(stale, ["session", "index"], "left").join(read, ["session", "index"], "left")

    mine = chooser(F.col("role"), F.col("operations"))
    stands = _has("value") & F.exists(F.coalesce("__texts", F.array().cast("array<string>")), lambda x: F.contains(F.col("value"), x))
    no_type = F.coalesce("__dead", F.lit(False)) | stands | (mine & F.col("__open") & (F.col("__op") == "type") & F.col("__chose"))
    no_click = F.col("__stale").isNotNull() | (mine & ~transient(F.col("role"), F.col("within")) & F.col("__open") & F.col("__op").isin("click", "type"))
    out = F.when(F.col("kind") == "type", no_type).when(F.col("kind") == "click", no_click).when(F.col("kind") == "read", F.col("__read").isNotNull())
    return t.where(~F.coalesce(out, F.lit(False))).select(*targets.columns)
