"""Domain tables derived from the driver's parquet tables, in Spark.

Every view covers its whole source tables.  ``workload.sql`` holds the same definitions for the checking engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.operators.cleaning import clean_items, clean_ratings, with_user_bucket
from tastegrid.operators.split import train_test
from tastegrid.session import reuse


class Views:
    """Lazily built views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._ratings: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def ratings_raw(self) -> DataFrame:
        """Ratings of parts by customers: 0.0 .. 6.0 in half steps, null for one quantity, dated to the year."""
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate", "l_linenumber")
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        half_steps = F.floor((F.col("l_quantity") - 1) / 4).cast("double") / 2
        new_year = F.make_date(F.year("l_shipdate"), F.lit(1), F.lit(1))
        return lines.join(orders, "l_orderkey").select(
            F.col("o_custkey").cast("int").alias("user_id"),
            F.col("l_partkey").cast("int").alias("item_id"),
            F.when(F.col("l_quantity") != 13, half_steps).alias("rating"),
            (F.unix_date(new_year).cast("long") * 86400).alias("ts"),
            F.col("l_orderkey").alias("src_order"),
            F.col("l_linenumber").alias("src_line"),
        )

    def ratings(self) -> DataFrame:
        return clean_ratings(self.ratings_raw()) if self._ratings is None else self._ratings

    def keep_ratings(self) -> Views:
        """Clean the ratings once for a query that reads them in several places, each with other columns."""
        if self._ratings is None:
            self._ratings = reuse(self.ratings())
        return self

    @property
    def keeps_ratings(self) -> bool:
        return self._ratings is not None

    def items_raw(self) -> DataFrame:
        """Parts as items: some titles without a year, some genre lists with a blank or a placeholder."""
        dated = F.concat("p_name", F.lit(" ("), (F.col("p_size") + 1950).cast("string"), F.lit(")"))
        words = F.concat(F.replace("p_name", F.lit(" "), F.lit("|")), F.lit("|"), "p_type")
        gap = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("||"), "p_type")
        return self.table("part").select(
            F.col("p_partkey").cast("int").alias("item_id"),
            F.when(F.col("p_size") % 10 == 0, F.col("p_name")).otherwise(dated).alias("title"),
            F.when(F.col("p_partkey") % 97 == 0, F.lit("(no genres listed)"))
            .when(F.col("p_partkey") % 89 == 0, gap)
            .otherwise(words)
            .alias("genres"),
        )

    def items(self) -> DataFrame:
        return clean_items(self.items_raw())

    def candidates(self, by_item: bool = False) -> DataFrame:
        """A stand-in for model output with exact scores: each rated item and three others per rating.

        It grows with the ratings, covers all users, and includes rated items, items outside the catalogue and scores
        beyond both ends of the rating scale. ``by_item`` says where the same rows lie, for those who join them by item.
        """
        catalogue = self.table("part").agg(F.max("p_partkey") + 4).scalar()
        # Equal pairs become one with all others below.
        pairs = self.ratings().select("user_id", "item_id")
        steps = pairs.withColumn("step", F.explode(F.array(*[F.lit(step) for step in range(4)])))
        user, item = F.col("user_id").cast("long"), F.col("item_id").cast("long")
        other = ((user * 31 + item * 17 + F.col("step") * 7919) % catalogue).cast("int")
        chosen = steps.select("user_id", F.when(F.col("step") == 0, F.col("item_id")).otherwise(other).alias("item_id"))
        if by_item:
            chosen = chosen.repartition("item_id")
        score = F.lit(0.25) + ((user * 31 + item * 17) % 41).cast("double") / 8
        return chosen.distinct().withColumn("als_score", score)

    def train_test(self) -> tuple[DataFrame, DataFrame]:
        return train_test(self.ratings())

    def events(self) -> DataFrame:
        """Behaviour events in the library's layout; purchases are ratings, sign-ups are skips, errors stay."""
        kind = F.lower(F.trim("event_type"))
        renamed = F.when(kind == "purchase", "rate").when(kind == "signup", "skip").otherwise(kind)
        day = F.unix_date(F.to_date("ts")).cast("long")
        return self.table("events").select(
            "event_id",
            F.replace(F.substring(F.col("ts").cast("string"), 1, 19), F.lit(" "), F.lit("T")).alias("timestamp"),
            (day * 86400).alias("day_ts"),
            renamed.alias("event_type"),
            F.col("user_id").cast("int").alias("user_id"),
            F.get_json_object("props", "$.k").cast("int").alias("item_id"),
            F.col("value"),
            F.from_json("props", "map<string,string>").alias("metadata"),
        )

    def feedback(self) -> DataFrame:
        """Ratings collected from the ``rate`` events: 0.0 .. 6.0 in half steps, dated to the day."""
        rated = self.events().filter(F.col("event_type") == "rate")
        rating = F.floor(F.col("value") % 13).cast("double") / 2
        return rated.select("user_id", "item_id", rating.alias("rating"), F.col("day_ts").alias("ts"))

    def merged(self) -> DataFrame:
        from tastegrid.operators.cleaning import merge_feedback

        return merge_feedback(self.ratings(), self.feedback())

    def requests(self) -> DataFrame:
        """One request per customer, and per supplier as a user without history."""

        def asked(table: str, key: str, base: int) -> DataFrame:
            number = F.col(key)
            size = F.when(number % 4 == 0, 5).when(number % 4 == 1, 10).when(number % 4 == 2, 20)
            genre = (
                F.when(number % 5 == 1, "ECONOMY")
                .when(number % 5 == 2, "red")
                .when(number % 5 == 3, "no-such-genre")
                .when(number % 5 == 4, "Bolt")
            )
            return self.table(table).select(
                (number + base).alias("request_id"),
                (number + base).cast("int").alias("user_id"),
                size.cast("int").alias("top_n"),
                genre.alias("genre"),
            )

        return asked("customer", "c_custkey", 0).unionByName(asked("supplier", "s_suppkey", 900000))

    def profiles(self) -> DataFrame:
        """Customers as profiles; nations are the accounts that own them."""
        segment = F.col("c_mktsegment")
        mode = F.when(segment == "BUILDING", "ca_nhan_hoa").when(segment == "MACHINERY", "so_thich_ban_dau")
        return self.table("customer").select(
            F.col("c_custkey").alias("profile_id"),
            F.col("c_nationkey").alias("account_id"),
            F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("profile_name"),
            mode.alias("mode"),
            F.when(segment == "AUTOMOBILE", F.col("c_custkey")).cast("int").alias("user_id"),
            F.when(segment == "HOUSEHOLD", "Economy").alias("preferred_genre"),
            F.when(F.col("c_acctbal") >= 0, "hoat_dong").otherwise("ngung").alias("status"),
        )

    def profile_requests(self) -> DataFrame:
        """One request per order for the customer's profile, some through an account that does not own it."""
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
        owners = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        wrong = F.when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(0)
        genre = F.when(F.col("o_orderstatus") == "F", "red").when(F.col("o_orderstatus") == "P", "")
        return orders.join(owners, "o_custkey").select(
            F.col("o_orderkey").alias("request_id"),
            F.col("o_custkey").alias("profile_id"),
            (F.col("c_nationkey") + wrong).alias("account_id"),
            F.lit(10).alias("top_n"),
            genre.alias("genre"),
        )

    def profile_writes(self) -> DataFrame:
        """Ratings on the scale as writes to the profile rating table."""
        from tastegrid.functions import on_scale

        return self.ratings_raw().filter(on_scale()).select(
            F.col("user_id").alias("profile_id"),
            "item_id",
            "rating",
            F.lit("ui").alias("source"),
            F.col("ts").alias("rated_at"),
            F.col("src_order").alias("write_no"),
        )

    def history(self) -> DataFrame:
        """Orders as recommendation history."""
        status = F.col("o_orderstatus")
        return self.table("orders").select(
            F.col("o_orderkey").alias("history_id"),
            F.col("o_custkey").alias("profile_id"),
            F.when(status == "O", "hybrid").when(status == "F", "fallback").otherwise("als_legacy").alias("route"),
            F.lit(10).alias("top_n"),
            F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("created_at"),
        )

    def bucketed_ratings(self) -> DataFrame:
        return with_user_bucket(self.ratings())
