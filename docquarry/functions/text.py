"""Column functions over text: tokenisers, keys, numerals, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK_GAP = r"(?<=[一-鿿]) +(?=[一-鿿])"
CJK_RUN = r"[一-鿿]{2,}"


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse_cjk(text: Column) -> Column:
    return F.regexp_replace(text, CJK_GAP, "")


def terms(text: Column) -> Column:
    """Lower-case alphanumeric terms of two characters or more, then the bigrams of CJK runs."""
    low = F.lower(collapse_cjk(F.coalesce(text, F.lit(""))))
    plain = F.regexp_extract_all(low, F.lit(r"[a-zA-Z0-9]{2,}"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(CJK_RUN), F.lit(0))
    bigrams = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2))))
    return F.concat(plain, bigrams)


def token_set(text: Column) -> Column:
    """Distinct lower-case tokens between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda x: x != ""))


def content_hash(text: Column) -> Column:
    return F.substring(F.md5(F.substring(text, 1, 2000)), 1, 16)


def query_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.lower(strip(text)), 256), 1, 16)


def fusion_key(text: Column) -> Column:
    return F.md5(F.substring(text, 1, 200))


def relevance(query: Column, text: Column) -> Column:
    """Share of the query's distinct characters that stand in the first 500 characters of the text; 0.5 for an empty query."""
    q = F.array_distinct(F.split(F.lower(query), ""))
    both = F.size(F.array_intersect(q, F.split(F.lower(F.substring(text, 1, 500)), "")))
    return F.when(query == "", F.lit(0.5)).otherwise(F.least(F.lit(1.0), both / F.size(q)))


def recency(age_hours: Column) -> Column:
    """Halves every 12 hours, at least 0.1; 0.5 without a time and 1 for the future."""
    return F.when(age_hours.isNull(), 0.5).when(age_hours < 0, 1.0).otherwise(F.greatest(F.lit(0.1), F.pow(F.lit(2.0), -age_hours / 12)))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.expr("int(1)") * F.floor(F.length(text) / 2)).cast("long")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def left(text: Column, n: Column | int) -> Column:
    """The first ``n`` characters."""
    return F.substring(text, F.lit(1), F.lit(n) if isinstance(n, int) else n.cast("int"))


#: Fixed values of the numerals, and the pattern of a chapter's number.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}
NUMERAL = r"[零〇一二三四五六七八九十百千\d]+"


def numeral(text: Column) -> Column:
    """A Chinese numeral under a thousand, or digits, as a number; what is not known counts 0."""
    s = strip(text)
    digit = lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DIGITS.items() for x in kv]), c), F.lit(0))
    part = lambda c, by, i: F.coalesce(F.get(F.split(c, by), F.lit(i)), F.lit(""))
    hundreds = F.when(s.contains("百"), digit(part(s, "百", 0)) * 100).otherwise(0)
    rest = F.when(s.contains("百"), part(s, "百", 1)).otherwise(s)
    head = part(rest, "十", 0)
    tens = F.when(rest.contains("十"), F.when(head == "", 10).otherwise(digit(head) * 10)).otherwise(0)
    units = F.when(rest.contains("十"), part(rest, "十", 1)).otherwise(rest)
    return F.when(s.rlike(r"^\d+$"), F.try_to_number(s, F.lit("9999999999")).cast("int")).otherwise(hundreds + tens + digit(units))


def chapter_slug(title: Column) -> Column:
    """``_Ch`` and the number of a title such as 第十二章 or Chapter 12; empty where there is none."""
    found = F.regexp_extract(title, rf"^第\s*({NUMERAL})\s*[章童篇]", 1)
    number = F.when(found == "", F.regexp_extract(title, r"(?i)^Chapter\s+(\d+)", 1)).otherwise(found)
    return F.when(F.coalesce(number, F.lit("")) == "", "").otherwise(F.concat(F.lit("_Ch"), numeral(number)))


def normal_title(title: Column) -> Column:
    """A heading without marks, doubled spaces, control characters and common misreadings, with a colon after its number."""
    t = F.regexp_replace(strip(title), r"(?U)^#{1,3}\s+", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    t = F.regexp_replace(t, "([第十])[童量]", "$1章")
    number = F.regexp_extract(t, rf"^(第\s*{NUMERAL}\s*[章童篇部单元])", 1)
    rest = strip(F.substring(t, F.length(number) + 1, F.length(t)))
    clean = F.translate(number, "童篇部", "章章章")
    t = F.when(number == "", t).when(rest == "", clean).otherwise(F.concat(clean, F.lit("："), rest))
    english = F.regexp_extract(t, r"(?i)^(Chapter\s+\d+)", 1)
    tail = strip(F.substring(t, F.length(english) + 1, F.length(t)))
    t = F.when(english == "", t).when(tail == "", english).otherwise(F.concat(english, F.lit(": "), tail))
    return strip(F.regexp_replace(t, r"(?U)[\s.。…\-—：:，、]+$", ""))


def collapse_space(text: Column) -> Column:
    """Runs of colons and of white space as one space."""
    return strip(F.regexp_replace(F.regexp_replace(text, "[：:]+", " "), r"(?U)\s+", " "))


def first_object(text: Column) -> Column:
    """The first JSON object of a text, found by counting its braces; null where they do not close."""
    tail = F.substring(text, F.instr(text, "{"), F.length(text))
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("read"), F.lit(0).alias("end"))

    def step(a: Column, c: Column) -> Column:
        depth = a["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        ends = (c == "}") & (depth == 0) & (a["end"] == 0)
        return F.struct(depth.alias("depth"), (a["read"] + 1).alias("read"), F.when(ends, a["read"] + 1).otherwise(a["end"]).alias("end"))

    end = F.aggregate(F.split(tail, ""), state, step, lambda a: a["end"])
    return F.when((F.instr(text, "{") > 0) & (end > 0), F.substring(tail, F.lit(1), end))


def query_lines(text: Column, fallback: Column) -> Column:
    """Search queries of a text: its first six usable lines without numbering, five at most; ``fallback`` where there are none."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: (F.length(x) >= 2) & ~x.startswith("#") & ~x.startswith("- "))
    clean = F.filter(F.transform(F.slice(lines, 1, 6), lambda x: strip(F.regexp_replace(x, r"^\d+[.)、]\s*", ""))), lambda x: F.length(x) >= 2)
    return F.when(F.size(clean) > 0, F.slice(clean, 1, 5)).otherwise(F.array(fallback))


def tool_calls(text: Column, tool: str) -> Column:
    """The queries after ``tool:`` in a text, without quotes."""
    found = F.regexp_extract_all(text, F.lit(rf'(?im){tool}\s*[：:]\s*"*\s*(.+?)\s*"*(?:\n|$)'), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(strip(x), "^[\"']+|[\"']+$", "")), lambda x: x != "")


#: Stage and lesson by what was insufficient; tools that a plan may name.
STAGES = {"plan": "planner.plan", "knowledge": "rewriter", "reasoning": "planner.solve"}
TOOLS = ("rag_search", "web_search", "mineru_ocr")


def failure_stage(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv]), kind), F.lit(""))


def allowed_tool(tool: Column) -> Column:
    return F.when(tool.isin(*TOOLS), tool).otherwise(TOOLS[0])


PLAN = "struct<sub_questions:array<struct<id:int,question:string,keywords:array<string>,target_doc:string,tool:string,depends_on:array<int>>>>"


def plan_items(text: Column) -> Column:
    """The sub-questions of a plan in JSON, with defaults for what is missing; none where it cannot be read."""
    items = F.from_json(first_object(text), PLAN)["sub_questions"]
    whole = lambda x, i: F.struct(
        F.coalesce(x["id"], i + 1).alias("id"),
        F.coalesce(x["question"], F.lit("")).alias("question"),
        F.coalesce(x["keywords"], F.array().cast("array<string>")).alias("keywords"),
        F.coalesce(x["target_doc"], F.lit("")).alias("target_doc"),
        allowed_tool(x["tool"]).alias("tool"),
        F.coalesce(x["depends_on"], F.array().cast("array<int>")).alias("depends_on"),
    )
    return F.coalesce(F.transform(F.filter(items, lambda x: x.isNotNull()), whole), F.transform(F.array().cast("array<string>"), lambda x: F.struct(F.lit(0).alias("id"), x.alias("question"), F.array(x).alias("keywords"), x.alias("target_doc"), x.alias("tool"), F.array(F.lit(0)).alias("depends_on"))))


def plan_of_queries(queries: Column) -> Column:
    """At most five queries as independent sub-questions with ids from 900 on."""
    return F.transform(F.slice(queries, 1, 5), lambda q, i: F.struct((i + 900).alias("id"), q.alias("question"), F.array(q).alias("keywords"), F.lit(TOOLS[0]).alias("tool")))


def feedback(missing: Column, queries: Column, issues: Column) -> Column:
    part = lambda label, xs: F.when(F.size(xs) > 0, F.concat(F.lit(label), F.array_join(xs, "；")))
    return F.array_join(F.array_compact(F.array(part("缺失知识点：", missing), part("建议搜索查询：", queries), part("回答问题：", issues))), "。")


def expand_range(prefix: Column, first: Column, last: Column) -> Column:
    """Ids ``prefix`` + number, from ``first`` to ``last``; none where ``last`` is less."""
    return F.when(last >= first, F.transform(F.sequence(first, last), lambda i: F.concat(prefix, i.cast("string")))).otherwise(F.array().cast("array<string>"))


def enriched_query(question: Column, context: Column, keywords: Column, most: int = 8) -> Column:
    """Keywords of a question, with it in front of 400 characters of context as the text to rewrite: at most eight, without repeats."""
    asked = F.when(context == "", question).otherwise(F.concat(question, F.lit("\n["), F.substring(context, 1, 400), F.lit("]")))
    return F.struct(asked.alias("asked"), F.slice(F.array_union(keywords, F.array(question)), 1, most).alias("keywords"))
