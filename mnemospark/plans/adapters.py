"""The memory model over the warehouse tables: memories, entities, mentions, relations, turns, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mnemospark.functions import text as X
from mnemospark.operators.graph import cooccurrence
from mnemospark.operators.index import ORDER, changes
from mnemospark.operators.recall import Index
from mnemospark.sources.scratch import written

BASE, HOUR = 1_700_000_000, 3600
NOW = BASE + 1000 * HOUR
#: Rows of the larger graph in a task.
DEALT = 500_000
#: The kinds of a memory.
KINDS = ("fact", "decision", "preference", "rule", "reference")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str, content: bool = True) -> DataFrame:
    """A memory per distinct (source, text), in order of hash within each file: exact copies are re-observations.

    Texts move once, to be grouped; groups are put in order where they are, so a lookup by hash reads a row group of each file.
    What labels and titles say of a group is found on rows without texts, which join them as one more row of the group.
    Without content no text moves: its words are taken where it is read.
    """
    by, first = ["hash", "project_key"], lambda c: F.min_by(c, "doc_id").alias(c)
    title = F.substring(F.regexp_extract("text", r"^[^.\n]*", 0), 1, 48)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.col("source").alias("project_key"))
    docs = docs.withColumn("hash", X.content_hash(F.col("project_key"), F.col("text")))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", *by, title.alias("title")).join(labels, "doc_id", "left")
    told = rows.groupBy(*by).agg(F.min("doc_id").alias("seq"), first("title"), F.coalesce(F.sum("quality"), F.lit(0)).cast("long").alias("used_count"), F.coalesce(F.sum("toxic"), F.lit(0)).cast("long").alias("disputed_count"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("seq") % 5 + 1).cast("int"))
    told = told.withColumns({"title_lc": F.lower("title"), "kind": kind})
    # of equal (project, title, kind) the later replaces the earlier
    told = told.withColumn("superseded", F.lead("hash").over(W.partitionBy("project_key", "title_lc", "kind").orderBy("seq")).isNotNull())
    what = F.struct("title", "title_lc", "kind", "used_count", "disputed_count", "superseded")
    words = lambda title, text: X.tokenize(F.concat_ws(" ", title, text), 32)
    said = "text" if content else "own"
    whole = docs.select(*by, "doc_id", F.col("text") if content else words(title, "text").alias("own"), "lang").unionByName(told.select(*by, what.alias("told")), allowMissingColumns=True)
    m = whole.groupBy(*by).agg(first(said), first("lang"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.when(F.col("told").isNull(), 1)).alias("seen_count"), F.max("told").alias("told"))
    m = m.select("*", "told.*").drop("told")
    m = m.sortWithinPartitions("hash")
    aliases = F.array("lang", "project_key", F.concat_ws("-", "lang", "project_key"))
    m = m.select("hash", F.substring("hash", 1, 16).alias("id"), "title", "title_lc", F.col("text").alias("content") if content else F.coalesce("own", F.array().cast("array<string>")).alias("own"), "kind", aliases.alias("aliases"), "project_key", "lang",
        (F.lit(BASE) + F.col("first_id") * HOUR).alias("created_at"), (F.lit(BASE) + F.col("last_id") * HOUR).alias("last_seen_at"), "seen_count", "used_count", "disputed_count",
        F.when(F.col("used_count") > 0, F.lit(BASE) + F.col("last_id") * HOUR).alias("last_used_at"), (F.col("first_id") % 37 == 0).alias("archived"), (F.col("first_id") % 41 == 0).alias("pinned"), F.col("first_id").alias("seq"), "superseded")
    # the text is tokenized once, and projections are kept apart so that it is not inlined again
    m = m.withColumns(({"own": words("title", "content")} if content else {}) | {"of_alias": X.tokenize(F.concat_ws(" ", "aliases"), 24)})
    return m.withColumns({"keywords": F.array_union("own", "of_alias"), "alias_only": F.array_except("of_alias", "own")}).drop("of_alias")


def mentions(mem: DataFrame) -> DataFrame:
    """(hash, entity_key, name, etype, project_key, created_at): four long keywords of a memory and its topic."""
    long = F.slice(F.filter("own", lambda t: F.length(t) >= 9), 1, 4)
    names = F.array_distinct(F.concat(F.transform(long, lambda t: F.struct(t.alias("name"), F.lit("term").alias("etype"))), F.array(F.struct(F.concat_ws("/", "project_key", "lang").alias("name"), F.lit("topic").alias("etype")))))
    held = mem.select("hash", "project_key", "created_at", "seq", F.explode(names).alias("e"))
    return held.select("hash", F.concat("project_key", F.lit("\0"), "e.name").alias("entity_key"), "e.name", "e.etype", "project_key", "created_at", "seq")


def entities(ment: DataFrame) -> DataFrame:
    e = ment.groupBy("entity_key").agg(F.min("name").alias("name"), F.min_by("etype", "seq").alias("etype"), F.min("project_key").alias("project_key"), F.min("created_at").alias("created_at"))
    return e.withColumns({"name_lc": F.lower("name"), "tokens": X.tokenize(F.col("name"), 8)})


def related(ment: DataFrame) -> DataFrame:
    return cooccurrence(ment.select(F.col("hash").alias("item"), F.col("entity_key").alias("key")))


_stored: dict[tuple[str, str, str], DataFrame] = {}
_built: dict[tuple[str, str], dict[str, DataFrame]] = {}


class Model:
    """The tables of the model over one data folder: derived once per application, as a save would, and stored."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def stored(self, name: str, build, *order: str) -> DataFrame:
        key = self.spark.sparkContext.applicationId, self.dir, name
        if key not in _stored:
            _stored[key] = written(build(), name, order)
        return _stored[key]

    @property
    def memory(self) -> DataFrame:
        return self.stored("memory", lambda: memories(self.spark, self.dir))

    @property
    def known(self) -> DataFrame:
        """The memories without their contents: of those that are stored whole, if they are."""
        if (self.spark.sparkContext.applicationId, self.dir, "memory") in _stored:
            return self.memory.drop("content")
        return self.stored("known", lambda: memories(self.spark, self.dir, content=False))

    def with_content(self, few: DataFrame) -> DataFrame:
        """Rows of known, so few that they go to all tasks, with their contents: the texts that they were first seen with. No other text moves."""
        docs = self.table("documents").select(F.col("doc_id").alias("seq"), "text", "source").join(F.broadcast(few.select("seq").distinct()), "seq", "left_semi")
        text = docs.select(X.content_hash(F.col("source"), F.col("text")).alias("_hash"), F.col("seq").alias("_seq"), "text").groupBy("_hash", "_seq").agg(F.min("text").alias("content"))
        # a plain equality would ask whether a hash is null, and so hash every text
        return few.join(text, (F.col("seq") == F.col("_seq")) & F.col("hash").eqNullSafe(F.col("_hash")), "left").drop("_hash", "_seq")

    @property
    def live(self) -> DataFrame:
        return live(self.memory)

    @property
    def mentions(self) -> DataFrame:
        return self.stored("mentions", lambda: mentions(self.known), "entity_key")

    @property
    def entity(self) -> DataFrame:
        return self.stored("entity", lambda: entities(self.mentions), "name_lc")

    @property
    def related(self) -> DataFrame:
        return self.stored("related", lambda: related(self.mentions), "k1")

    @property
    def corpus(self) -> DataFrame:
        """The number of live memories, kept with the index."""
        return self.stored("corpus", lambda: live(self.known).agg(F.count("*").alias("n")))

    @property
    def index(self) -> Index:
        """The index as one save of all would have left it; a table of it is stored when it is first asked for."""
        return Kept(self)

    def kept(self, name: str) -> DataFrame:
        """A table of the index."""

        def built() -> dict[str, DataFrame]:
            key = self.spark.sparkContext.applicationId, self.dir
            if key not in _built:
                _built[key] = derived()
            return _built[key]

        def derived() -> dict[str, DataFrame]:
            none = lambda df: df.limit(0)
            after = {"memory": self.known, "mentions": self.mentions, "entities": self.entity, "related": self.related}
            before = {"memory": none(self.known), "mentions": none(self.mentions.select("hash", "entity_key")), "entities": none(self.entity), "related": none(self.related)}
            return changes(before, after, 0)

        return self.stored(f"index-{name}", lambda: built()[name], *ORDER[name])

    def warm(self) -> None:
        """Derive and store what queries look up; a deployment does this as it saves."""
        for name in ("words", "names", "mentioned", "near", "grams"):
            self.kept(name)
        self.corpus  # noqa: B018

    @property
    def dealt(self) -> int:
        """The tasks that the larger graph is dealt to: of bounded rows, however many there are."""
        # with fewer than Spark's own number its joins would deal once more
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.table("lineitem").count() // DEALT))

    @property
    def basket(self) -> DataFrame:
        """The larger graph: parts as entities, orders as items, the customer's nation as project.

        It is dealt by item once; joins, what follows by item and the distinct rows find it so.
        """
        li = self.table("lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("key")).repartition(self.dealt, "item")
        orders = self.table("orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("c_custkey"))
        customer = self.table("customer").select("c_custkey", F.col("c_nationkey").alias("project"))
        return li.join(orders.join(customer, "c_custkey").select("item", "project"), "item").select("item", "key", "project").distinct()

    @property
    def events(self) -> DataFrame:
        e = self.table("events")
        return e.select("event_id", F.col("user_id").alias("session"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("ref"))

    @property
    def turns(self) -> DataFrame:
        return self.table("conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("line"), "role", "text").where("role in ('user', 'assistant')")


class Kept(Index):
    """The index of a model."""

    def __init__(self, model: Model):
        self.model, self._seeds = model, {}

    words, names, mentioned, near = (property(lambda self, n=n: self.model.kept(n)) for n in ("words", "names", "mentioned", "near"))


def live(mem: DataFrame) -> DataFrame:
    return mem.where(~F.coalesce("superseded", F.lit(False)) & ~F.coalesce("archived", F.lit(False)))
