"""The canonical tables, derived from the star-schema tables; the same text runs on Spark and on DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

#: Common table expressions over the base tables.
VIEWS = {
    "file": """select 'main' as repo_id, p_partkey as file_id,
        concat('src/', replace(p_brand, '#', '_'), '/', replace(p_type, ' ', '_'), '/File', cast(p_partkey as string), '.cs') as server_path,
        p_size as code, p_size % 7 as comments, p_size % 5 as blanks from part""",
    "change_set": """select 'main' as repo_id, o_orderkey as changeset_id, c_name as committer, o_orderdate as date,
        concat('PROJ-', cast(o_custkey % 50 as string), ' ', o_orderpriority) as comment, o_orderkey as cs_ord from orders join customer on o_custkey = c_custkey""",
    "change_item": """select 'main' as repo_id, l_orderkey as changeset_id,
        row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_tax, l_discount) as item_idx,
        l_partkey as file_id, l_suppkey as folder_id, file.server_path,
        case when (l_orderkey + l_partkey) % 13 = 0 then 32 when l_returnflag = 'A' then 2 when l_returnflag = 'N' then 4 else 16 end as kind,
        case when (l_orderkey + l_partkey) % 13 <> 0 and l_returnflag = 'R' then concat('src/moved/File', cast(l_partkey % 97 as string), '.cs') end as from_server_path
        from lineitem join file on l_partkey = file.file_id""",
    "contribution": """select 'main' as repo_id, lower(server_path) as path_key, s_name as developer, cast(sum(l_quantity) as bigint) as lines
        from lineitem join supplier on l_suppkey = s_suppkey join file on l_partkey = file.file_id group by server_path, s_name""",
    "loc": "select repo_id, lower(server_path) as path_key, blanks, comments, code from file where file_id % 10 <> 3",
    "alias_map": "select s_name as name, n_name as alias from supplier join nation on s_nationkey = n_nationkey",
    "committer_alias": "select c_name as name, n_name as alias from customer join nation on c_nationkey = n_nationkey where c_custkey % 3 <> 0",
    "team": """select c_name as developer, r_name as team, timestamp '1994-01-01 00:00:00' as valid_from, cast(null as timestamp) as valid_to
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where c_custkey % 11 <> 0""",
    "commit_edge": """select 'main' as repo_id, o_orderkey as child, o_orderkey - 1 as parent, 0 as parent_idx from orders where o_orderkey % 100 > 0
        union all select 'main', o_orderkey, o_orderkey - 3, 1 from orders where o_orderkey % 100 > 3 and o_orderkey % 7 = 0""",
}


class Tables:
    """The views as DataFrames, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.made: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        if name not in self.made:
            words = set(VIEWS[name].replace("(", " ").replace(",", " ").split())
            used = [t for t in TABLES if t in words]
            sources = {t: self.base(t) for t in used}
            text = VIEWS[name]
            if "join file " in text or "from file " in text:
                sources["file"] = self.file
            for t in sources:
                text = text.replace(f"from {t}", f"from {{{t}}} as {t}").replace(f"join {t} ", f"join {{{t}}} as {t} ")
            self.made[name] = self.spark.sql(text, **sources)
        return self.made[name]


def with_views(query: str, *names: str) -> str:
    """A DuckDB query over the views."""
    need = [n for n in VIEWS if n in names or (n == "file" and {"change_item", "contribution", "loc"} & set(names))]
    if not need:
        return query
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in need) + "\n" + query
