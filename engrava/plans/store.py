"""Queries over the stored layers and their profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrava.functions import notes
from engrava.functions.text import fingerprint, is_blank, normalised, weighted_length
from engrava.operators import delivery, gates, store
from engrava.sources import read_table

CUTOFF = 1678000000.0


def q03_vector_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = read_table(spark, sf_dir, "facts", "agent", "vector")
    return facts.groupBy(F.coalesce("agent", F.lit("unattributed")).alias("agent"), store.vector_state(F.col("vector"), 64).alias("state")).agg(F.count("*").alias("n_facts"))


def q24_content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.newest_by_content(read_table(spark, sf_dir, "facts", "fact_id", "content", "timestamp"))


def q25_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "facts", "fact_id", "content").select("fact_id", fingerprint(F.col("content")).alias("fp"))


def q26_tombstoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.tombstoned(read_table(spark, sf_dir, "facts", "fact_id", "content"), read_table(spark, sf_dir, "tombstones", "fp", "content_prefix"))


def q29_mirror_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts whose source message is gone, and user messages that gave no fact, each as a count."""
    facts = read_table(spark, sf_dir, "facts", "source_rowid").where("source_rowid IS NOT NULL").select(F.col("source_rowid").alias("id"))
    messages = read_table(spark, sf_dir, "messages", "id", "role")
    lost = facts.join(messages.select("id"), "id", "left_anti").agg(F.lit("fact_without_message").alias("drift"), F.count("*").alias("n"))
    silent = messages.where(delivery.plain_role(F.col("role")) == "user").join(facts, "id", "left_anti").agg(F.lit("message_without_fact").alias("drift"), F.count("*").alias("n"))
    return lost.unionByName(silent)


def q30_index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Note files against the paths that candidates came from: what a rebuild of that index would do, by state."""
    stored = read_table(spark, sf_dir, "documents", "path", F.coalesce(F.unix_micros("updated") / 1e6, F.lit(0.0)).alias("mtime"))
    index = read_table(spark, sf_dir, "candidates", F.col("source_path").alias("path"), "updated_at").where("path IS NOT NULL")
    index = index.groupBy("path").agg(F.max(F.unix_micros(F.try_to_timestamp("updated_at")) / 1e6).alias("mtime"))
    return store.index_difference(stored, index).groupBy("state").agg(F.count("*").alias("n_paths"))


def q34_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of concepts (tags and entities) named together in at least two notes or distinct candidates."""
    named = store.latest_exports(read_table(spark, sf_dir, "candidates", "id", "entities", "tags", "updated_at", "imported_at", "summary"))
    none = F.array().cast("array<string>")
    sets = named.select(F.concat(F.coalesce("entities", none), F.coalesce("tags", none)).alias("es")).unionByName(read_table(spark, sf_dir, "documents", "text").where("text IS NOT NULL").select(notes.tags(F.col("text")).alias("es")))
    sets = sets.select(F.array_sort(F.array_distinct(F.filter("es", lambda e: e.isNotNull()))).alias("es")).where(F.size("es") > 1)
    pairs = F.flatten(F.transform("es", lambda a, i: F.transform(F.filter("es", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("entity_a"), F.col("p.b").alias("entity_b")).agg(F.count("*").alias("weight")).where("weight >= 2")


def q35_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of notes and candidates that reach their threshold of three."""
    docs = read_table(spark, sf_dir, "documents", "text").select(F.lit("notes").alias("origin"), F.explode(notes.tags(F.col("text"))).alias("tag"))
    cand = read_table(spark, sf_dir, "candidates", "tags").select(F.lit("candidates").alias("origin"), F.explode("tags").alias("tag"))
    return docs.unionByName(cand).where("tag IS NOT NULL").groupBy("origin", "tag").agg(F.count("*").alias("n")).where("n >= 3")


def q36_session_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest session, its share of all rows, and whether that is a warning (half of 500 rows or more)."""
    sizes = read_table(spark, sf_dir, "messages", "session_id").groupBy(delivery.session_name(F.col("session_id")).alias("session_id")).agg(F.count("*").alias("n"))
    whole = sizes.agg(F.sum("n").alias("n_rows"), F.max(F.when(F.col("session_id").isNotNull(), F.struct("n", "session_id"))).alias("top"))
    share = F.col("top.n") / F.col("n_rows")
    return whole.select(F.col("top.session_id").alias("session_id"), F.col("top.n").alias("n_top"), "n_rows", F.round(share, 4).alias("share"), ((share >= 0.5) & (F.col("n_rows") >= 500)).alias("warn"))


def q37_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User wording that recurs three times or more: normalised without punctuation, with its first row and last time."""
    rows = read_table(spark, sf_dir, "messages", "id", "role", "content", "timestamp").where((delivery.plain_role(F.col("role")) == "user") & ~is_blank(F.col("content")))
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower("content"), r"[^\p{L}\p{N}\s]", ""), r"(?U)\s+", " "))
    return rows.groupBy(key.alias("wording")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.round(F.max(delivery.seconds(F.col("timestamp"))), 3).alias("last_seen")).where((F.col("n") >= 3) & (F.length("wording") >= 4))


def q38_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by controlled category; names off the list, however spelled, count as other."""
    plain = F.lower(F.trim("category"))
    named = F.when(plain.isin("meta", "user", "environment", "tooling", "project", "workflow", "reference"), plain).otherwise("other")
    return read_table(spark, sf_dir, "facts", "category", "content").groupBy(named.alias("category")).agg(F.count("*").alias("n_facts"), F.countDistinct(normalised(F.col("content"))).alias("n_distinct"))


def q39_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and candidates of each agent; the unattributed apart."""
    facts = read_table(spark, sf_dir, "facts", F.coalesce("agent", F.lit("unattributed")).alias("agent"), F.lit(1).alias("f"), F.lit(0).alias("c"))
    named = read_table(spark, sf_dir, "candidates", F.coalesce(F.get_json_object("metadata", "$.agent"), F.lit("unattributed")).alias("agent"), F.lit(0).alias("f"), F.lit(1).alias("c"))
    return facts.unionByName(named).groupBy("agent").agg(F.sum("f").alias("n_facts"), F.sum("c").alias("n_candidates"))


def q40_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by length class and whether they repeat an earlier fact's normalised text."""
    facts = read_table(spark, sf_dir, "facts", "fact_id", "content")
    text = normalised(F.coalesce("content", F.lit("")))
    first = facts.groupBy(text.alias("text")).agg(F.min("fact_id").alias("first"))
    size = F.when(F.length("text") == 0, "empty").when(weighted_length(F.col("text")) < 15, "short").when(F.length("text") > 500, "long").otherwise("fit")
    marked = facts.select("fact_id", text.alias("text")).join(first, "text")
    return marked.groupBy(size.alias("size_class"), (F.col("fact_id") > F.col("first")).alias("repeats")).agg(F.count("*").alias("n_facts"))


def q44_secret_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold secret-like strings, by pattern, over messages and documents."""
    texts = read_table(spark, sf_dir, "messages", F.col("content").alias("text")).unionByName(read_table(spark, sf_dir, "documents", "text"))
    return texts.where("text IS NOT NULL").select(F.explode(gates.secret_names(F.col("text"))).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n_texts"))


def q46_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of 10 to 500 characters by role, with how many are questions' neighbours cut off and how many are distinct."""
    rows = read_table(spark, sf_dir, "messages", "role", "content").where("content IS NOT NULL")
    cut = rows.select(F.coalesce(delivery.plain_role(F.col("role")), F.lit("unknown")).alias("plain_role"), F.explode(F.split("content", r"[.!?。！？\n]")).alias("s")).select("plain_role", F.trim("s").alias("s"))
    return cut.where(F.length("s").between(10, 500)).groupBy("plain_role").agg(F.count("*").alias("n_sentences"), F.countDistinct("s").alias("n_distinct"), F.sum(F.length("s")).alias("n_chars"))


def q48_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts against the message they came from: by whether it is there and whether the roles agree."""
    facts = read_table(spark, sf_dir, "facts", "fact_id", "source_rowid", "role")
    messages = read_table(spark, sf_dir, "messages", F.col("id").alias("source_rowid"), delivery.plain_role(F.col("role")).alias("message_role"), F.lit(True).alias("there"))
    state = F.when(F.col("source_rowid").isNull(), "external").when(F.col("there").isNull(), "lost").when(F.col("role") == F.col("message_role"), "agrees").when(F.col("role").isNull(), "unset").otherwise("differs")
    return facts.join(messages, "source_rowid", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n_facts"))


def q49_role_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts without a role that get one from their message."""
    facts = read_table(spark, sf_dir, "facts", "fact_id", "source_rowid", "role").where("role IS NULL AND source_rowid IS NOT NULL")
    messages = read_table(spark, sf_dir, "messages", F.col("id").alias("source_rowid"), delivery.plain_role(F.col("role")).alias("new_role"))
    return facts.join(messages, "source_rowid").where("new_role IS NOT NULL").select("fact_id", "new_role")


def q50_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.over_capacity(read_table(spark, sf_dir, "facts", "fact_id", "agent", "timestamp"), 100)


def q55_session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's first user row, longest assistant row, and last time; ties to the smaller id."""
    rows = read_table(spark, sf_dir, "messages", "id", "session_id", "role", "content", "timestamp")
    rows = rows.select("id", delivery.session_name(F.col("session_id")).alias("session_id"), delivery.plain_role(F.col("role")).alias("r"), F.length("content").alias("n"), delivery.seconds(F.col("timestamp")).alias("sec"))
    first = F.min(F.when(F.col("r") == "user", F.struct(F.coalesce("sec", F.lit(float("inf"))).alias("s"), "id")))
    longest = F.min(F.when((F.col("r") == "assistant") & F.col("n").isNotNull(), F.struct((-F.col("n")).alias("n"), "id")))
    told = rows.where("session_id IS NOT NULL").groupBy("session_id").agg(first.alias("f"), longest.alias("l"), F.round(F.max("sec"), 3).alias("last_time"), F.count("*").alias("n_rows"))
    return told.select("session_id", F.col("f.id").alias("first_user"), F.col("l.id").alias("longest_assistant"), "last_time", "n_rows")


def q56_valuable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long user rows that state a rule: how many in each session."""
    rows = read_table(spark, sf_dir, "messages", "session_id", "role", "content").where("content IS NOT NULL")
    good = (delivery.plain_role(F.col("role")) == "user") & (weighted_length(F.col("content")) >= 50) & F.lower("content").rlike(r"\b(always|never|must|prefers?|remember|because)\b|因为|除非|记住")
    return rows.where(good).groupBy(delivery.session_name(F.col("session_id")).alias("session_id")).agg(F.count("*").alias("n_valuable"), F.max(F.length("content")).cast("bigint").alias("longest"))


def q57_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed notes: title, status and number of tags and links."""
    return read_table(spark, sf_dir, "documents", "doc_id", "text").where("text IS NOT NULL").select(
        "doc_id", notes.title(F.col("text")).alias("title"), notes.field(F.col("text"), "status").alias("status"), F.size(notes.tags(F.col("text"))).cast("bigint").alias("n_tags"), F.size(notes.links(F.col("text"))).cast("bigint").alias("n_links")
    )


def q32_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets with the number of notes that link to them, and whether a note has that name (file stem or title)."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "path", "text").where("text IS NOT NULL")
    out = docs.select("doc_id", F.explode(notes.links(F.col("text"))).alias("target")).groupBy("target").agg(F.count("*").alias("n_notes"))
    names = docs.select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("target")).unionByName(docs.select(notes.title(F.col("text")).alias("target"))).distinct().withColumn("known", F.lit(True))
    return out.join(names, "target", "left").select("target", "n_notes", F.coalesce("known", F.lit(False)).alias("known"))


def q62_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 2,000 facts: a snapshot has this limit by definition."""
    return read_table(spark, sf_dir, "facts", "fact_id", "content", "timestamp").orderBy(F.desc_nulls_last("timestamp"), "fact_id").limit(2000)


def q63_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before the cutoff and rows that stay, by role."""
    sec = delivery.seconds(F.col("timestamp"))
    rows = read_table(spark, sf_dir, "messages", "role", "timestamp")
    return rows.groupBy(F.coalesce(delivery.plain_role(F.col("role")), F.lit("unknown")).alias("plain_role")).agg(F.count_if(sec < CUTOFF).alias("n_expired"), F.count_if(sec.isNull() | (sec >= CUTOFF)).alias("n_kept"))


def q65_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.usage(read_table(spark, sf_dir, "events", "user_id", "ts"), "user_id", "ts").select("key", "hits", F.unix_micros(F.col("last_used").cast("timestamp")).alias("last_used"))


def q66_hour_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and sessions in each hour, the widest tumbling bucket of the feed."""
    rows = read_table(spark, sf_dir, "messages", "session_id", "timestamp").select(delivery.session_name(F.col("session_id")).alias("sid"), F.floor(delivery.seconds(F.col("timestamp")) / 3600).alias("hour"))
    return rows.where("hour IS NOT NULL").groupBy("hour").agg(F.count("*").alias("n_rows"), F.countDistinct("sid").alias("n_sessions"))


def q68_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest exports by target and state of import."""
    latest = store.latest_exports(read_table(spark, sf_dir, "candidates", "id", "target", "imported", "imported_at", "updated_at", "summary"))
    state = F.when(~F.coalesce("imported", F.lit(False)), "open").when(F.col("imported_at").isNull(), "imported_undated").otherwise("imported")
    return latest.groupBy(F.coalesce(F.lower(F.trim("target")), F.lit("none")).alias("target"), state.alias("state")).agg(F.count("*").alias("n_candidates"), F.sum("n_exports").alias("n_exports"))


QUERIES = {n: f for n, f in dict(globals()).items() if n.startswith("q") and n[1:3].isdigit()}
