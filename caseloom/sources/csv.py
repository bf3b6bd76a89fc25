"""CSV landing: everything is read as text, '' is null, and columns are found by their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import standardize as st
from caseloom.operators import sides
from caseloom.sources import records


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings with trimmed names, a byte-order mark dropped, empty values null; ``_file`` is the source file."""
    df = spark.read.option("header", True).option("inferSchema", False).option("encoding", "UTF-8").option("multiLine", False).csv(path)
    names = [c.strip().lstrip("﻿") for c in df.columns]
    df = df.toDF(*names)
    return df.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in names], F.col("_metadata.file_name").alias("_file"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a stated schema."""
    return spark.read.schema(schema).json(path)


def write_graph_csv(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Entity, link and attribute tables as CSV."""
    vertices.select("v_id", "label", "key").write.mode("overwrite").option("header", True).csv(f"{path}/entity")
    edges.write.mode("overwrite").option("header", True).csv(f"{path}/link")
    vertices.select("v_id", F.explode("props").alias("name", "value")).write.mode("overwrite").option("header", True).csv(f"{path}/attribute")


def write_graph(vertices: DataFrame, edges: DataFrame, path: str, complete: tuple[DataFrame, DataFrame] | None = None) -> None:
    """The graph as Parquet, partitioned by label so that a label is a folder to prune.

    ``complete``: further edges, as left(src, label, keys) and right(dst, label, keys) of relations that are complete between the two; they are stored like this.
    """
    vertices.write.mode("overwrite").partitionBy("label").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").partitionBy("label").parquet(f"{path}/edges")


    for end, df in zip(("left", "right"), complete or ()):
        df.write.mode("overwrite").partitionBy("label").parquet(f"{path}/edges_{end}")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and all edges."""
    edges, ends = spark.read.parquet(f"{path}/edges"), read_sides(spark, path)
    if ends:
        edges = edges.unionByName(sides.labelled(*ends))
    return spark.read.parquet(f"{path}/vertices"), edges


def read_sides(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """The two sides of the edges that are stored as such; None if there are none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/edges_left")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(f"{path}/edges_left"), spark.read.parquet(f"{path}/edges_right")


def edge_summary(spark: SparkSession, path: str, label: str) -> DataFrame:
    """(label, n, least, most): of a label's stored edges the count, the smallest src and the largest dst. Only its folders are read, and no pair of sides is made."""
    own = spark.read.parquet(f"{path}/edges").filter(F.col("label") == label)
    found = own.groupBy("label").agg(F.count("*").alias("n"), F.min("src").alias("least"), F.max("dst").alias("most"))
    ends = read_sides(spark, path)
    if ends:
        found = found.unionByName(sides.label_summary(*[x.filter(F.col("label") == label) for x in ends]))
    return found.groupBy("label").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def profile(df: DataFrame, name: str) -> DataFrame:
    """One row per column of a table with its type, and how many values and how many nulls it has."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), F.struct(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).alias("of"))
    kinds = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    pairs = F.explode(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col("of")[c])])).alias("column", "n")
    return counts.select("rows", pairs).select(F.lit(name).alias("table_name"), "column", kinds[F.col("column")].alias("type"), "n", (F.col("rows") - F.col("n")).alias("nulls"))


def serial(*parts: Column) -> Column:
    """A surrogate key from the natural row, the same at every load."""
    return F.xxhash64(*parts)


# --- predefined layouts (S3) --------------------------------------------------------------------

def load_layout(name: str, df: DataFrame) -> dict[str, DataFrame]:
    """Target table -> rows, for one of the nine predefined files; ``name`` is the file's name."""
    c = F.col
    has = lambda *cols: [c(x).isNotNull() for x in cols]

    def rows(where, **cols):
        out = df
        for w in where:
            out = out.filter(w)
        return out.select(*[(x if isinstance(x, Column) else F.lit(x)).alias(k) for k, x in cols.items()]).distinct()

    if "tbl_vt_psn" in name:
        return {"TB_PRSN": rows(has("flnm"), PRSN_ID=c("flnm"), KORN_FLNM=c("flnm"), PRSN_SE_CD="99")}
    if "tbl_vt_telno" in name:
        return {"TB_TELNO_MST": rows(has("telno"), TELNO=c("telno"), TELCO_NM=c("tlcmco"), JOIN_TYP_CD="01")}
    if "tbl_vt_bacnt" in name:
        return {"TB_FIN_BACNT": rows(has("actno"), BACNT_NO=c("actno"), BANK_CD="999", BANK_NM=c("bank"), DPSTR_NM=c("dpstr"))}
    if "tbl_eg_call" in name:
        start, end = c("bgng_ymdhm"), c("end_ymdhm")
        phones = rows(has("dsptch_no"), TELNO=c("dsptch_no"), TELCO_NM=c("tlcmco"), JOIN_TYP_CD="01").unionByName(rows(has("rcptn_no"), TELNO=c("rcptn_no"), TELCO_NM=F.lit(None).cast("string"), JOIN_TYP_CD="01"))
        call = rows(has("dsptch_no", "rcptn_no"), CALL_SN=serial(F.lit("call"), c("id"), c("dsptch_no"), c("rcptn_no"), start), DSPTCH_TELNO=c("dsptch_no"), RCPTN_TELNO=c("rcptn_no"), CALL_STRT_DT=F.try_to_timestamp(start), CALL_DUR_SEC=st.duration_seconds(start, end), CALL_TYP_CD=st.call_type(c("se")))
        return {"TB_TELNO_MST": phones, "TB_TELNO_CALL_DTL": call}
    if "tbl_eg_rmt" in name:
        deposit, taken = st.amount(c("dpst_amt")), st.amount(c("tkmny_amt"))
        accounts = rows(has("actno"), BACNT_NO=c("actno"), BANK_CD="999", BANK_NM=c("bank"), DPSTR_NM=c("dpstr")).unionByName(rows(has("rlt_actno"), BACNT_NO=c("rlt_actno"), BANK_CD="999", BANK_NM=c("rlt_bank"), DPSTR_NM=c("rlt_dpstr")))
        moved = rows(has("actno", "rlt_actno"), DLNG_SN=serial(F.lit("rmt"), c("id"), c("actno"), c("rlt_actno"), c("rmt_ymdhm")), BACNT_NO=c("actno"), BANK_CD="999", DLNG_DT=F.try_to_timestamp(c("rmt_ymdhm")), DLNG_SE_CD=F.when(c("se") == "입금", "01").otherwise("02"), DLNG_AMT=F.when(deposit > 0, deposit).otherwise(taken), TRRC_PSNNM=c("rlt_dpstr"), TRRC_BACNT_NO=c("rlt_actno"))
        logins = rows(has("Ip"), LGN_EVT_SN=serial(F.lit("lgn"), c("id"), c("Ip"), c("rmt_ymdhm")), USER_ID=F.coalesce(c("dpstr"), F.lit("UNKNOWN")), CNNT_IP_ADDR=c("Ip"), LGN_DT=F.try_to_timestamp(c("rmt_ymdhm")))
        return {"TB_FIN_BACNT": accounts, "TB_FIN_BACNT_DLNG": moved, "TB_SYS_LGN_EVT": logins}
    if "tbl_eg_bactno_poss" in name:
        return {"TB_PRSN": rows(has("flnm"), PRSN_ID=c("flnm"), KORN_FLNM=c("flnm"), PRSN_SE_CD="99"), "TB_FIN_BACNT": rows(has("actno"), BACNT_NO=c("actno"), BANK_CD="999", BANK_NM=F.lit(None).cast("string"), DPSTR_NM=c("flnm"))}
    if "tbl_eg_telno_poss" in name:
        return {
            "TB_PRSN": rows(has("flnm"), PRSN_ID=c("flnm"), KORN_FLNM=c("flnm"), PRSN_SE_CD="99"),
            "TB_TELNO_MST": rows(has("telno"), TELNO=c("telno"), TELCO_NM=F.lit(None).cast("string"), JOIN_TYP_CD="01"),
            "TB_TELNO_JOIN": rows(has("telno", "flnm"), JOIN_SN=serial(F.lit("join"), c("telno"), c("flnm")), TELNO=c("telno"), JOIN_PSNNM=c("flnm")),
        }
    if "case_prsn" in name:  # before the case file, whose name it contains
        return {"TB_INCDNT_PRSN": rows(has("incdnt_no", "prsn_id"), INCDNT_NO=c("incdnt_no"), PRSN_ID=c("prsn_id"), ROLE_CD=c("role"))}
    if "tbl_eg_case" in name:
        return {"TB_INCDNT_MST": rows(has("incdnt_no"), INCDNT_NO=c("incdnt_no"), INCDNT_NM=c("incdnt_nm"), INCDNT_TYP_CD=c("incdnt_typ_cd"), OCCRN_DT=F.try_to_timestamp(c("occrn_dt")), INCDNT_SMRY_CN=c("incdnt_smry_cn"))}
    raise ValueError(f"no layout for {name}")


#: Keys of the target tables; other columns take the batch's last solid value.
KEYS = {
    "TB_PRSN": ["PRSN_ID"], "TB_TELNO_MST": ["TELNO"], "TB_FIN_BACNT": ["BACNT_NO"], "TB_TELNO_CALL_DTL": ["CALL_SN"], "TB_FIN_BACNT_DLNG": ["DLNG_SN"], "TB_SYS_LGN_EVT": ["LGN_EVT_SN"],
    "TB_TELNO_JOIN": ["JOIN_SN"], "TB_INCDNT_PRSN": ["INCDNT_NO", "PRSN_ID"], "TB_INCDNT_MST": ["INCDNT_NO"], "TB_FRD_VCTM_RPT": ["DCLR_SN"], "TB_WEB_DMN": ["DMN_ADDR"], "TB_WEB_URL": ["URL_ADDR"], "TB_VHCL_MST": ["VHCLNO"], "TB_DGTL_FILE_INVNT": ["FILE_SN"], "TB_INST": ["INST_ID"],
    "TB_TELNO_SMS_MSG": ["SMS_SN"], "TB_CHAT_MSG": ["CHAT_SN"], "TB_GEO_MBL_LOC_EVT": ["LOC_EVT_SN"], "TB_VHCL_LPR_EVT": ["RCGN_SN"],
}


def merge_loads(loads: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The loads of several files as one table each: per key, of every other column the last solid value.

    Later loads come after earlier ones; rows of one load have no order, so of several values in it the largest counts.
    Null and blank values never replace others.
    """
    out: dict[str, DataFrame] = {}
    for place, load in enumerate(loads):
        for name, df in load.items():
            df = df.withColumn("_load", F.lit(place))
            out[name] = out[name].unionByName(df, allowMissingColumns=True) if name in out else df

    def last(c):
        there = F.when(F.trim(F.col(c).cast("string")) != "", F.struct("_load", F.col(c).alias("v")))
        return F.max(there)["v"].alias(c)

    return {name: df.groupBy(*KEYS[name]).agg(*[last(c) for c in df.columns if c not in (*KEYS[name], "_load")]) for name, df in out.items()}


# --- generic wide files (S4) --------------------------------------------------------------------

def fan_out(df: DataFrame, mapping: dict[str, str]) -> dict[str, DataFrame]:
    """Target table -> rows of one wide file; ``mapping`` is field -> column, as column mapping finds it."""
    c = lambda f: F.col(f"`{mapping[f]}`") if f in mapping else F.lit(None).cast("string")
    fields = ("case", "crime", "date", "suspect", "nickname", "name", "account", "sender", "receiver", "amount", "phone", "caller", "callee", "ip", "url", "file", "vehicle", "org", "message", "bank", "lat", "lng")
    d = df.select(*[F.nullif(F.trim(c(f)), F.lit("")).alias(f) for f in fields])
    d = d.withColumn("person", F.coalesce("suspect", "nickname", "name")).withColumn("src", F.coalesce("sender", "account")).withColumn("dst", F.coalesce("receiver", "account"))
    pick = lambda where, *cols: d.filter(where).select(*cols).distinct()
    account = lambda f: pick(f"{f} is not null", F.col(f).alias("BACNT_NO"), F.coalesce(st.bank_code(F.col("bank")), F.lit("999")).alias("BANK_CD"), F.col("person").alias("DPSTR_NM"), F.col("org").alias("INST_ID"))
    phone = lambda f: pick(f"{f} is not null", F.col(f).alias("TELNO"), F.lit("01").alias("JOIN_TYP_CD"))
    amount = st.amount(F.col("amount"))
    time = F.try_to_timestamp(F.col("date"))
    d = d.withColumn("msg_from", F.coalesce("caller", "phone")).withColumn("msg_to", F.coalesce("callee", "phone")).withColumn("holder", F.coalesce("name", "person"))
    placed = records.with_coordinates(d, "lat", "lng")
    return {
        "TB_INCDNT_MST": pick("case is not null", F.col("case").alias("INCDNT_NO"), F.col("crime").alias("INCDNT_NM"), F.substring("crime", 1, 6).alias("INCDNT_TYP_CD"), F.try_to_timestamp(F.col("date")).alias("OCCRN_DT")),
        "TB_PRSN": pick("person is not null", F.col("person").alias("PRSN_ID"), F.coalesce("name", "person").alias("KORN_FLNM"), F.lit("01" if "suspect" in mapping else "99").alias("PRSN_SE_CD"), F.col("nickname").alias("RMK_CN")),
        "TB_FIN_BACNT": account("account").unionAll(account("sender")).unionAll(account("receiver")).distinct(),
        "TB_FIN_BACNT_DLNG": pick("src is not null and dst is not null and src <> dst", serial(F.lit("dlng"), "case", "src", "dst", "amount", "date").alias("DLNG_SN"), F.col("src").alias("BACNT_NO"), F.col("dst").alias("TRRC_BACNT_NO"), F.lit("03").alias("DLNG_SE_CD"), amount.alias("DLNG_AMT"), F.try_to_timestamp(F.col("date")).alias("DLNG_DT")),
        "TB_TELNO_MST": phone("phone").unionAll(phone("caller")).unionAll(phone("callee")).distinct(),
        "TB_TELNO_CALL_DTL": pick("caller is not null and callee is not null", serial(F.lit("call"), "case", "caller", "callee", "date").alias("CALL_SN"), F.col("caller").alias("DSPTCH_TELNO"), F.col("callee").alias("RCPTN_TELNO")),
        "TB_TELNO_JOIN": pick("phone is not null and holder is not null", serial(F.lit("join"), "case", "phone", "holder").alias("JOIN_SN"), F.col("phone").alias("TELNO"), F.col("holder").alias("JOIN_PSNNM")),
        "TB_TELNO_SMS_MSG": pick("message is not null and msg_from <> msg_to", serial(F.lit("sms"), "case", "msg_from", "msg_to", "date", "message").alias("SMS_SN"), F.col("msg_from").alias("DSPTCH_TELNO"), F.col("msg_to").alias("RCPTN_TELNO"), time.alias("DSPTCH_DT"), F.substring("message", 1, 4000).alias("MSG_CN")),
        "TB_CHAT_MSG": pick("message is not null and nickname is not null", serial(F.lit("chat"), "case", "nickname", "date", "message").alias("CHAT_SN"), F.col("nickname").alias("DSPTCH_USER_ID"), F.col("message").alias("MSG_CN"), time.alias("DSPTCH_DT"), F.lit("미상").alias("APP_NM")),
        "TB_GEO_MBL_LOC_EVT": placed.filter("phone is not null").select(serial(F.lit("loc"), "case", "phone", "lat", "lng", "date").alias("LOC_EVT_SN"), F.col("phone").alias("TELNO"), F.col("lat").alias("BSST_LAT"), F.col("lng").alias("BSST_LOT"), time.alias("OCCRN_DT")).distinct(),
        "TB_VHCL_LPR_EVT": placed.filter("vehicle is not null").select(serial(F.lit("lpr"), "case", "vehicle", "lat", "lng", "date").alias("RCGN_SN"), F.col("vehicle").alias("VHCLNO"), time.alias("RCGN_DT"), F.col("lat").alias("LAT"), F.col("lng").alias("LOT")).distinct(),
        "TB_SYS_LGN_EVT": pick("ip is not null", serial(F.lit("lgn"), "case", "ip", "person").alias("LGN_EVT_SN"), F.coalesce("person", F.lit("UNKNOWN_USER")).alias("USER_ID"), F.col("ip").alias("CNNT_IP_ADDR")),
        "TB_FRD_VCTM_RPT": pick("case is not null and (person is not null or account is not null or phone is not null)", serial(F.lit("dclr"), "case", "person", "account", "phone").alias("DCLR_SN"), amount.alias("DAM_AMT"), F.col("phone").alias("SUSPCT_TELNO"), F.col("account").alias("SUSPCT_BACNT_NO"), F.concat(F.lit("사건참조:"), "case").alias("DAM_CN")),
        "TB_INST": pick("org is not null", F.col("org").alias("INST_ID"), F.col("org").alias("INST_NM")),
        "TB_WEB_DMN": pick("url is not null", st.domain(F.col("url")).alias("DMN_ADDR"), F.col("ip").alias("IP_ADDR")),
        "TB_WEB_URL": pick("url is not null", F.col("url").alias("URL_ADDR"), st.domain(F.col("url")).alias("DMN_ADDR")),
        "TB_VHCL_MST": pick("vehicle is not null", F.col("vehicle").alias("VHCLNO"), F.col("person").alias("OWNR_NM")),
        "TB_DGTL_FILE_INVNT": pick("file is not null", serial(F.lit("file"), "case", "file").alias("FILE_SN"), F.col("file").alias("FILE_NM"), st.extension(F.col("file")).alias("FILE_EXTSN_NM"), F.sha2("file", 256).alias("NAME_SHA256")),
    }
