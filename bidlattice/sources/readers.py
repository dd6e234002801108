"""Reading: tables, ledgers by header alias, frontmatter documents, page texts, files by their first bytes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Header names of ledgers and the columns that they mean.
LEDGER_HEADERS: dict[str, dict[str, tuple[str, ...]]] = {
    "qualifications": {
        "category": ("资质类别", "类别", "category"), "level": ("资质等级", "等级", "level"), "specialty": ("专业", "specialty"),
        "valid_from": ("有效期起", "发证日期", "valid_from"), "valid_until": ("有效期至", "有效期止", "valid_until"), "issuer": ("发证机关", "issuer"),
        "evidence_refs": ("证据引用", "附件", "evidence_refs"), "data_owner": ("数据责任人", "data_owner"),
    },
    "performances": {
        "project_name": ("项目名称", "工程名称", "project_name"), "project_type": ("工程类型", "project_type"), "contract_amount": ("合同金额", "合同金额（元）", "contract_amount"),
        "contract_amount_wan": ("合同金额（万元）", "contract_amount_wan"), "completed_at": ("竣工日期", "completed_at"), "awarded_at": ("中标日期", "awarded_at"),
        "owner_org": ("建设单位", "owner_org"), "scale": ("规模", "scale"), "evidence_refs": ("证据引用", "evidence_refs"), "data_owner": ("数据责任人", "data_owner"),
    },
    "personnel": {
        "name": ("姓名", "name"), "organization": ("单位", "organization"), "specialty": ("专业", "specialty"), "cert_level": ("证书等级", "cert_level"), "cert_no": ("证书编号", "cert_no"),
        "valid_from": ("有效期起", "valid_from"), "valid_until": ("有效期至", "valid_until"), "on_site": ("是否在场", "on_site"), "evidence_refs": ("证据引用", "evidence_refs"),
    },
}
#: First bytes of files, as hex, and what they mean.
MAGIC = (("25504446", "pdf"), ("504B0304", "zip"), ("D0CF11E0", "ole"), ("89504E47", "image"), ("FFD8FF", "image"), ("47494638", "image"), ("49492A00", "image"), ("4D4D002A", "image"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A1: a whole table; filters and columns asked for later reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """A2: a point lookup, pushed to the scan."""
    return df.where(F.col(key) == F.lit(value))


def ledger(spark: SparkSession, path: str, kind: str, headers: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """A CSV ledger under our column names, each row's own reference added to its evidence.

    The header line is matched by alias; an unknown header is dropped, a column without a header is null. Row numbers
    come from the file's own order, so a ledger is read as one split; it is a sheet that people keep by hand.
    """
    raw = spark.read.option("header", True).option("multiLine", True).csv(path)
    aliases = headers or LEDGER_HEADERS[kind]
    have = {c.strip(): c for c in raw.columns}
    pick = {name: next((have[a] for a in names if a in have), None) for name, names in aliases.items()}
    out = raw.withColumn("row_no", F.monotonically_increasing_id() + 2)
    out = out.select("row_no", *[F.trim(F.col(f"`{c}`")).alias(n) if c else F.lit(None).cast("string").alias(n) for n, c in pick.items()])
    if "contract_amount_wan" in pick:
        wan = F.expr("try_cast(contract_amount_wan as decimal(18,6))") * 10_000
        out = out.withColumn("contract_amount", F.coalesce(F.expr("try_cast(contract_amount as decimal(18,2))"), wan.cast("decimal(18,2)"))).drop("contract_amount_wan")
    refs = F.filter(F.split(F.coalesce("evidence_refs", F.lit("")), "[;；,，]"), lambda x: F.trim(x) != "")
    return out.withColumn("evidence_refs", F.array_append(F.transform(refs, F.trim), F.concat(F.lit("ledger:csv:row"), F.col("row_no").cast("string"))))


def material_refs(refs: Column) -> Column:
    """C17: references to files, without those to ledger rows and certificate numbers."""
    return F.filter(refs, lambda x: ~x.rlike("^(ledger:|cert_no:)"))


def frontmatter(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Documents whose head between --- lines holds `key: value` lines, as (path, type, fields, body)."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    head = F.regexp_extract("value", r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_]\w*:"))
    trimmed = lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")
    entries = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^(\w+):", 1).alias("k"), trimmed(F.regexp_extract(x, r"^\w+:(.*)$", 1)).alias("v")))
    out = whole.select("path", F.map_from_entries(entries).alias("fields"), F.regexp_extract("value", r"(?s)^---\r?\n.*?\r?\n---\r?\n?(.*)$", 1).alias("body"))
    out = out.withColumn("type", F.col("fields")["type"])
    return out if kind is None else out.where(F.col("type") == kind)


def intake(current: DataFrame, dropped: DataFrame, key: str = "intake_id") -> DataFrame:
    """Current and dropped intake files as one table; of one id the dropped one counts."""
    every = current.withColumn("dropped", F.lit(False)).unionByName(dropped.withColumn("dropped", F.lit(True)), allowMissingColumns=True)
    first = every.groupBy(key).agg(F.bool_or("dropped").alias("__d"))
    return every.join(first, key).where(F.col("dropped") == F.col("__d")).drop("__d")


def routed(files: DataFrame) -> DataFrame:
    """Files (path, content) with their kind: by extension, else by first bytes, else text if it reads as UTF-8."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in {"pdf": "pdf", "docx": "docx", "doc": "ole", "xlsx": "xlsx", "csv": "csv", "txt": "text", "md": "text", "html": "html", "htm": "html", "png": "image", "jpg": "image", "jpeg": "image", "tif": "image"}.items() for x in kv])
    first = F.hex(F.substring("content", 1, 4))
    magic = F.lit(None).cast("string")
    for head, kind in reversed(MAGIC):
        magic = F.when(first.startswith(head), kind).otherwise(magic)
    textual = F.is_valid_utf8(F.col("content").cast("string")) & ~F.coalesce(F.hex("content").rlike("^(..)*00"), F.lit(False))
    return files.withColumn("kind", F.coalesce(F.try_element_at(known, ext), magic, F.when(textual, "text"), F.lit("unknown")))


def text_pages(docs: DataFrame, doc: str = "doc_id", body: str = "text") -> DataFrame:
    """Pages of a text at its form feeds, numbered from 1; empty pages stay, so that numbers hold."""
    return docs.select(doc, F.posexplode(F.split(body, "\f")).alias("page_no", "text")).withColumn("page_no", F.col("page_no") + 1)


def scanned(pages: DataFrame, doc: str = "doc_id", least: int = 50) -> DataFrame:
    """Whether a document's pages hold too little text to be more than images."""
    return pages.groupBy(doc).agg((F.avg(F.length(F.trim("text"))) < least).alias("scanned"))


def ocr_confidence(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean confidence of recognised words, those with a positive one, from 0 to 1."""
    return words.groupBy(*keys).agg(F.avg(F.when(F.col("conf") > 0, F.col("conf") / 100)).alias("ocr_confidence"))


def altered_objects(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored objects whose bytes are gone or no longer have their digest."""
    now = files.select("path", F.sha2("content", 256).alias("now"))
    return stored.join(now, "path", "left").where(F.col("now").isNull() | (F.col("now") != F.col("sha256"))).select("path", F.when(F.col("now").isNull(), "missing").otherwise("altered").alias("fault"))


def first_seen_urls(rows: DataFrame, url: str, order: Sequence[str]) -> DataFrame:
    """A5: the first row of each address by the order."""
    rest = [c for c in rows.columns if c != url]
    return rows.groupBy(url).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(url, "r.*")


#: Sources by id, level, region, whether they may be collected, and their compliance state.
SOURCES = (
    ("hebtig", "L1", "河北省", True, "verified"), ("hebtig_service", "L1", "河北省", True, "verified"), ("hebtig_goods", "L1", "河北省", True, "verified"), ("hebtig_nzb", "L1", "河北省", True, "verified"),
    ("ggzy", "L1", "全国", True, "verified"), ("ccgp", "L1", "全国", True, "verified"), ("cebpubservice", "L1", "全国", True, "pending"), ("ggzyfw-beijing", "L1", "北京市", True, "pending"),
    ("ccgp-beijing", "L1", "北京市", True, "verified"), ("ccgp-tianjin", "L1", "天津市", True, "verified"), ("ggzy-tianjin", "L1", "天津市", True, "pending"), ("ccgp-hebei-web", "L1", "河北省", True, "verified"),
    ("szj-hebei", "L1", "河北省", True, "verified"), ("zhjy-bcactc", "L1", "北京市", True, "pending"), ("sjzsggzy", "L2", "石家庄市", True, "verified"), ("tsggzy", "L2", "唐山市", True, "verified"),
    ("hdggzy", "L2", "邯郸市", True, "verified"), ("qhdggzy", "L2", "秦皇岛市", False, "blocked"), ("cdggzy", "L2", "承德市", True, "verified"), ("hsggzy", "L2", "衡水市", True, "verified"),
    ("cangzhou", "L2", "沧州市", False, "pending"), ("xingtai", "L2", "邢台市", False, "blocked"), ("qianlima", "L0", "全国", False, "blocked"), ("jianyu360", "L0", "全国", False, "blocked"),
    ("bidcenter", "L0", "全国", False, "blocked"), ("bidizhaobiao", "L0", "全国", False, "blocked"),
)


def source_registry(spark: SparkSession) -> DataFrame:
    """The source dimension."""
    return spark.createDataFrame(list(SOURCES), "source_id string, level string, region string, collectable boolean, compliance string")
