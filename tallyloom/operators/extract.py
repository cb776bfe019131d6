"""Values from semi-structured text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A label before a colon, of up to twenty characters without marks that end a sentence, and its value; longer values are reported, not read.
LABEL, LONGEST = r"^\s*([^:：。；;，,\n]{1,20}?)\s*[:：]\s*(.*?)\s*$", 80
# Labels that name a subject, by its role; labels of a legal representative; labels of a certificate's number and its kind; titles that begin a section.
SUBJECTS = {"借款人": ("借款人名称", "借款人", "客户", "申请人", "授信申请人", "用信人"), "保证人": ("保证人名称", "保证人", "担保人", "保证方")}
REPRESENTATIVES = ("法定代表人", "法人代表", "法人")
CERTIFICATES = ("证件号码", "证件号", "身份证号", "身份证号码", "护照号", "护照号码", "证件类型", "证件种类")
TITLES = {"guarantee": ("保证合同",), "loan": ("流动资金贷款合同", "借款合同", "贷款合同"), "credit": ("授信合同", "授信协议")}
# Labels that may stand behind another value in one line.
INLINE = ("联系电话", "电话", "联系方式", "统一社会信用代码", "收款账号", "账号", "开户行", "开户银行", "用信金额", "借款用途", "用途", "法定代表人", "证件号码", "证件类型", "身份证号", "地址", "利率", "起始日", "到期日")
#: A guarantor with a number, as in 保证人（二）.
NUMBERED = r"^保证人[（(]?[0-9一二三四五六七八九十]+[）)]?(?:名称)?$"
# The one sentence of which an amount is read, and what else tells that a text without a label holds facts.
AMOUNT_SENTENCE = r"^本次借款金额为人民币(\d+(?:\.\d+)?)元[。.]?$"
NARRATIVE = r"(?:金额|借款|贷款|用信|授信|人民币).{0,24}?\d[\d,]*(?:\.\d+)?\s*(?:元|万元|人民币)|(?:账号|账户|卡号).{0,12}?\d{6,}|(?:身份证|护照|通行证|证件).{0,16}?[A-Za-z0-9-]{6,}"


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line from 0, line_text) of every line of a text."""
    return docs.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line", "line_text"))


def labelled(rows: DataFrame) -> DataFrame:
    """Adds label, value and issue to lines: a label with its value, or `too long` where the value is no value any more."""
    label, value = F.regexp_extract("line_text", LABEL, 1), F.regexp_extract("line_text", LABEL, 2)
    good = F.col("line_text").rlike(LABEL) & (value != "")
    return rows.withColumns({
        "label": F.when(good, F.regexp_replace(label, r"(?U)\s+", "")), "value": F.when(good & (F.length(value) <= LONGEST), value), "issue": F.when(good & (F.length(value) > LONGEST), "too long"),
    })


def split_labels(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line, part, line_text, quote): lines in which known labels follow a first labelled value, taken apart; `quote` is the whole line."""
    behind = r"\s+(" + "|".join(sorted(INLINE, key=lambda w: (-len(w), w))) + r")\s*[:：]"
    parts = F.when(F.col("line_text").rlike(LABEL), F.split(F.regexp_replace("line_text", behind, "\u0001$1："), "\u0001")).otherwise(F.array("line_text"))
    return rows.select(key, "line", F.col("line_text").alias("quote"), F.posexplode(parts).alias("part", "line_text")).select(key, "line", "part", "line_text", "quote")


def narratives(rows: DataFrame) -> DataFrame:
    """Adds amount and issue to lines (line_text, label): the amount of the one sentence that is read without a label, and
    `unparsed` for other lines without a label that tell amounts, accounts or certificates."""
    amount = F.nullif(F.regexp_extract("line_text", AMOUNT_SENTENCE, 1), F.lit(""))
    free = F.col("label").isNull()
    return rows.withColumns({"amount": F.when(free, amount), "narrative": F.when(free & amount.isNull() & F.col("line_text").rlike(NARRATIVE), "unparsed")})


def subject_role(label: Column) -> Column:
    """The role that a label declares for the subject it names; null for other labels."""
    out = F.when(label.rlike(NUMBERED), "保证人")
    for role, words in SUBJECTS.items():
        out = out.when(label.isin(*words), role)
    return out


def owned(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds role, owner, owner_kind and section to labelled lines (line, label, value; part if lines were split).

    A label that names a subject sets the name of its role for the rest of the document and makes the role the present one.
    After a guarantee's title nobody is the present one; after a loan's or credit's title the borrower is again, if known.
    A legal representative belongs to the role in its label, else to the present one, and certificates after it are that
    person's until the next subject or title. Any other label belongs to the role it begins with, else to the present one.

    Names, present role and person are last values of windows within a document, in the order of its lines.
    """
    order = Window.partitionBy(key).orderBy("line", "part") if "part" in rows.columns else Window.partitionBy(key).orderBy("line")
    label, value = F.col("label"), F.col("value")
    where = F.coalesce("label", "line_text")
    title = F.lit(None).cast("string")
    for name, words in TITLES.items():
        title = F.coalesce(title, F.when(where.rlike("|".join(words)), name))
    names = F.when(value.isNotNull(), subject_role(label))
    named = lambda role: F.last(F.when(F.col("names") == role, value), ignorenulls=True).over(order)
    rows = rows.withColumns({"title": title, "names": names}).withColumns({"borrower": named("借款人"), "guarantor": named("保证人"), "section": F.sum(F.col("title").isNotNull().cast("int")).over(order)})
    present = F.when(F.col("names").isNotNull(), F.col("names")).when(F.col("title") == "guarantee", "").when(F.col("title").isNotNull(), F.when(F.col("borrower").isNotNull(), "借款人").otherwise(""))
    rows = rows.withColumn("present", F.nullif(F.last(present, ignorenulls=True).over(order), F.lit("")))
    starts = F.when(label.startswith("借款人"), "借款人").when(label.startswith("保证人"), "保证人")
    legal = F.col("names").isNull() & value.isNotNull() & (label.isin(*REPRESENTATIVES) | (starts.isNotNull() & label.rlike("(" + "|".join(REPRESENTATIVES) + ")$")))
    rows = rows.withColumns({"legal": F.coalesce(legal, F.lit(False)), "starts": starts})
    person = F.when(F.col("names").isNotNull() | F.col("title").isNotNull(), "").when(F.col("legal"), value)
    rows = rows.withColumn("person", F.nullif(F.last(person, ignorenulls=True).over(order), F.lit("")))
    company = lambda role: F.when(role == "借款人", F.col("borrower")).when(role == "保证人", F.col("guarantor"))
    certificate = label.isin(*CERTIFICATES)
    of = F.when(certificate, F.col("present")).otherwise(F.coalesce("starts", "present"))
    human = certificate & F.col("person").isNotNull()
    owner = F.when(label.isNull(), None).when(F.col("names").isNotNull(), value).when(human, F.col("person")).otherwise(company(of))
    rows = rows.withColumn("owner", owner).withColumn("role", F.when(F.col("owner").isNotNull() & ~F.coalesce(human, F.lit(False)), F.coalesce("names", of)))
    kind = F.when(F.col("owner").isNull(), "unknown").when(human, "person").otherwise("subject")
    return rows.withColumn("owner_kind", F.when(label.isNotNull(), kind)).drop("title", "names", "borrower", "guarantor", "present", "legal", "starts", "person")


def text_counts(text: Column) -> Column:
    """struct(cjk, words, chars): Han characters, Latin words and all characters."""
    return F.struct(F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]")).alias("cjk"), F.regexp_count(text, F.lit("[A-Za-z]+")).alias("words"), F.length(text).alias("chars"))


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of spans of one place that share a character: (part, a_id, b_id, contains). Spans: (id, part, start, end), end beyond the last.

    Spans are cut into cells of CELL characters and meet by part and cell, each pair in its first common cell, so that a part
    with many spans is no group.
    """
    cell = lambda df, p: df.select("part", F.col("id").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / CELL))).alias("cell"))
    both = cell(a, "a").join(cell(b, "b"), ["part", "cell"])
    both = both.filter((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & (F.col("cell") == F.floor(F.greatest("a_start", "b_start") / CELL)))
    return both.select("part", "a_id", "b_id", ((F.col("a_start") <= F.col("b_start")) & (F.col("a_end") >= F.col("b_end"))).alias("contains"))


CELL = 256


def ocr_columns(boxes: DataFrame, gap: float = 0.8) -> DataFrame:
    """Adds `column` to boxes (page, left, right): a gap of more than `gap` median widths begins a new column."""
    widths = boxes.groupBy("page").agg(F.percentile(F.col("right") - F.col("left"), 0.5).alias("median_width"))
    order = Window.partitionBy("page").orderBy("left", "right")
    rows = boxes.join(widths, "page").withColumn("edge", F.max("right").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.coalesce(F.col("left") - F.col("edge") > gap * F.col("median_width"), F.lit(False))
    return rows.withColumn("column", F.sum(new.cast("int")).over(order)).drop("edge", "median_width")


def blank_slot(text: Column) -> Column:
    """Whether a text is a place to fill: nothing, or only underscores, dots, boxes and blanks."""
    return F.coalesce(text, F.lit("")).rlike(r"(?U)^[\s_＿.…·□☐/／\-—]*$")


# What stands before or after a place that a person signs or seals.
SIGNED_BEFORE, SIGNED_AFTER, SIGNED = r"(?:签字|签名|签章|盖章|签核|审批|审核|经办人)\s*[：:]?\s*$", r"^\s*(?:签字|签名|签章|盖章|签核|审批|审核|公章)", r"签字|签名|签章|盖章|签核|审批|公章"


def protected_slot(label: Column, before: Column, after: Column) -> Column:
    """Whether a blank is for a signature, an approval or a seal: by its label, the 16 characters before it or what follows it. Words elsewhere in the paragraph don't count."""
    near = F.right(F.coalesce(before, F.lit("")), F.lit(16)).rlike(SIGNED_BEFORE) | F.left(F.coalesce(after, F.lit("")), F.lit(12)).rlike(SIGNED_AFTER)
    return F.coalesce(label.rlike(SIGNED), F.lit(False)) | near


def short_label(text: Column) -> Column:
    """A table cell as a label: at most two lines of 24 characters, 40 in all, without marks of a sentence; null for anything else."""
    rows = F.filter(F.transform(F.split(text, r"\r?\n"), F.trim), lambda x: x != "")
    whole = F.trim(F.regexp_replace(F.array_join(rows, ""), "[：:]+$", ""))
    fits = (F.size(rows) <= 2) & (F.length(whole) <= 40) & ~F.exists(rows, lambda x: F.length(x) > 24) & ~whole.rlike("[。；;，,]")
    return F.when(fits & (whole != ""), whole)


def cell_labels(cells: DataFrame) -> DataFrame:
    """(doc, row, col, label, required) of cells (doc, row, col, text) that label the blank cell to their right; a star marks what is required."""
    right = F.lead(F.struct("col", "text")).over(Window.partitionBy("doc", "row").orderBy("col"))
    rows = cells.withColumn("right", right).filter((F.col("right.col") == F.col("col") + 1) & blank_slot(F.col("right.text")))
    label = short_label(F.regexp_replace("text", "[*＊]", ""))
    return rows.select("doc", "row", F.col("right.col").alias("col"), label.alias("label"), F.col("text").rlike("[*＊]").alias("required")).filter("label is not null")


#: A run of what stands for a blank in a line, and a colon at a line's end.
SLOT = r"[_＿]{2,}|[□☐]|…{2,}|(?<=[:：])\s*$"


def line_slots(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line, start, end, label, protected) of the blanks in lines (line, line_text): runs of underscores, boxes, dots, and the end of
    a line after a colon; start counts from 0. The label is what stands before the blank since the last mark."""
    t = F.col("line_text")
    found = rows.filter(t.rlike(SLOT)).withColumns({"between": F.split(t, SLOT), "blanks": F.regexp_extract_all(t, F.lit(SLOT), F.lit(0))})
    size = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda a, x: a + F.length(x))
    places = F.transform(F.sequence(F.lit(0), F.size("blanks") - 1), lambda i: F.struct((size(F.col("between"), i + 1) + size(F.col("blanks"), i)).alias("start"), F.get("blanks", i).alias("blank")))
    each = found.select(key, "line", "line_text", F.explode(places).alias("p")).select(key, "line", "line_text", F.col("p.start").alias("start"), (F.col("p.start") + F.length("p.blank")).alias("end"))
    before = F.call_function("substring", t, F.lit(1), F.col("start"))
    after = F.call_function("substring", t, F.col("end") + 1, F.lit(12))
    label = F.nullif(F.regexp_extract(before, r"([^\s:：。；;，,_＿□☐…]{1,24})\s*[:：]?\s*$", 1), F.lit(""))
    return each.select(key, "line", "start", "end", label.alias("label"), protected_slot(label, before, after).alias("protected"))


def text_width(text: Column) -> Column:
    """Columns a text takes in a fixed-width display: two for characters beyond U+2E80."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[^\x{0}-\x{2e80}]"))


def ocr_quality(boxes: DataFrame) -> DataFrame:
    """(page, boxes, mean, low) of boxes (page, confidence): the mean confidence to four places and how many are under 0.6."""
    return boxes.groupBy("page").agg(F.count("confidence").alias("boxes"), F.round(F.avg("confidence"), 4).alias("mean"), F.count_if(F.col("confidence") < 0.6).alias("low"))


def certificate_type(label: Column) -> Column:
    """The kind of certificate that a label asks for; null for other labels."""
    out = None
    for name, words in {"身份证": "身份证", "统一社会信用代码": "统一社会信用代码|信用代码", "护照": "护照", "营业执照": "营业执照", "其他": "证件号|证件号码"}.items():
        out = F.when(label.rlike(words), name) if out is None else out.when(label.rlike(words), name)
    return out


def page_numbers(spec: str, pages: int) -> list[int]:
    """The pages, from 1, of `1,3-5,8-`; those beyond the last are left out, each counts once."""
    out: dict[int, None] = {}
    for part in filter(None, (p.strip() for p in spec.replace("，", ",").split(","))):
        first, dash, last = part.partition("-")
        a, b = int(first or 1), (int(last or pages) if dash else int(first))
        out |= dict.fromkeys(n for n in range(a, b + 1) if 1 <= n <= pages)
    return list(out)
