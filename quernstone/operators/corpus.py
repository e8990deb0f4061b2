"""The corpus: cleaning, duplicate groups, tags and flags, counts, and data-quality rules."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from quernstone.functions import text as T
from quernstone.operators.study import questions
from quernstone.plans.ordered import place
from quernstone.session import table

#: Items a section should have per session, options of a choice question, and the length of a short text.
OPTIONS, SHORT = 4, 100
#: Similarity of options that makes questions of one text the same question.
OPTION_RATIO, NEAR_GATE, NEAR_RATIO = 0.9, 0.55, 0.82
# Patterns that mark a text for review, with their labels.
FLAGS = (("全角英数字", "[Ａ-Ｚａ-ｚ０-９]"), ("半角カナ", "[ｱ-ﾝ]"), ("0/O の混同疑い", "[0-9]{1,2}[oO][0-9]"), ("丸数字の連続", "[①-⑳]{2,}"), ("全角スペース", "　"))
#: Keyword rules of the own tables; rules of other corpora are given as a list of the same form.
TAG_RULES = (("暗号", ("暗号化", "共通鍵", "公開鍵", "署名鍵")), ("認証", ("認証", "パスワード", "SAML", "MFA")), ("通信", ("プロトコル", "DNS", "HTTP", "TLS", "DHCP")), ("運用", ("バックアップ", "監視", "障害対応", "権限管理")))
FALLBACK = "その他"


def has_keyword(s: Column, word: str) -> Column:
    """Whether a text holds a keyword; short ASCII words must stand alone."""
    if word.isascii() and 2 <= len(word) <= 8:
        return s.rlike(rf"(?<![A-Za-z0-9]){word}(?![A-Za-z0-9])")
    return s.contains(word)


def tags_for(s: Column, rules: tuple = TAG_RULES, fallback: str = FALLBACK) -> Column:
    """Names of all rules a text meets, in the rules' order, else the fallback."""
    hits = []
    for name, words in rules:
        met = has_keyword(s, words[0])
        for w in words[1:]:
            met = met | has_keyword(s, w)
        hits.append(F.when(met, name))
    found = F.array_compact(F.array(*hits))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(fallback)))


def flags_for(s: Column) -> Column:
    """Labels of all review patterns a text meets."""
    return F.array_compact(F.array(*[F.when(s.rlike(p), label) for label, p in FLAGS]))


@F.pandas_udf(DoubleType())
def sequence_ratio(a, b):  # noqa: ANN001, ANN202
    """Ratcliff-Obershelp similarity, the earlier text first."""
    import pandas as pd

    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def _choice(spark: SparkSession, folder: str) -> DataFrame:
    q = questions(spark, folder).filter("choices is not null and text is not null")
    return q.select("id", "section", "answer", "text", F.transform("choices", lambda c: F.coalesce(c["text"], F.lit(""))).alias("options"))


def q_clean_texts(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).filter("text is not null").select("id", T.tidy_blanks(F.col("text")).alias("cleaned"))


def q_booklet_texts(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).filter("text is not null").select("id", T.booklet(F.col("text")).alias("normal"))


def q_composed_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts composed and tidied, with their display width."""
    return questions(spark, folder).filter("text is not null").select("id", T.clean(F.col("text")).alias("cleaned"), T.display_width(F.col("text")).alias("width"))


def q_canonical_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Twelve digits of the digest of folded text and options."""
    q = _choice(spark, folder)
    body = F.concat_ws("|", T.canonical_plain(F.col("text")), F.array_join(F.transform("options", T.canonical_plain), "|"))
    return q.select("id", F.substring(F.sha1(body), 1, 12).alias("key"))


def q_same_text_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Choice questions whose folded texts and keys agree, with the size of their group."""
    q = _choice(spark, folder).withColumn("body", F.md5(T.canonical_plain(F.col("text"))))
    groups = q.groupBy("section", "body", "answer").agg(F.min("id").alias("head"), F.count("*").alias("size")).filter("size > 1")
    return q.join(groups, ["section", "body", "answer"]).select("id", "head", "size")


def q_group_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Stored duplicate groups numbered by size (largest first), then smallest id."""
    g = questions(spark, folder).filter("duplicateGroupId is not null").groupBy("duplicateGroupId").agg(F.count("*").alias("size"), F.min("id").alias("head")).filter("size > 1")
    # a running number over groups: counts per size decide where each size starts, so no task sees all groups
    sizes = g.groupBy("size").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = g.withColumn("own", F.row_number().over(Window.partitionBy("size").orderBy("head"))).join(F.broadcast(sizes.select("size", "before")), "size")
    return ranked.select("duplicateGroupId", "size", F.concat(F.lit("grp-"), F.lpad((F.col("before") + F.col("own")).cast("string"), 4, "0")).alias("number"))


def q_group_size_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).filter("duplicateGroupId is not null").groupBy("duplicateGroupId").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def q_unique_count(spark: SparkSession, folder: str) -> DataFrame:
    """Questions, and those left when each group counts once."""
    q = questions(spark, folder)
    return q.agg(F.count("*").alias("questions"), (F.count_if(F.col("duplicateGroupId").isNull()) + F.count_distinct("duplicateGroupId")).alias("unique"))


def q_option_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Mean similarity of options, taken in place, of questions of one stored group against its first."""
    q = questions(spark, folder).filter("duplicateGroupId is not null and choices is not null").select("id", "duplicateGroupId", F.transform("choices", lambda c: F.coalesce(c["text"], F.lit(""))).alias("options"))
    head = q.groupBy("duplicateGroupId").agg(F.min_by(F.struct("id", "options"), "id").alias("h"))
    pairs = q.join(head, "duplicateGroupId").filter("id <> h.id").select(F.col("h.id").alias("id_a"), F.col("id").alias("id_b"), F.posexplode(F.arrays_zip(F.col("h.options").alias("a"), F.col("options").alias("b"))).alias("pos", "z"))
    return pairs.select("id_a", "id_b", sequence_ratio(T.canonical(F.col("z.a")), T.canonical(F.col("z.b"))).alias("r")).groupBy("id_a", "id_b").agg(F.round(F.avg("r"), 3).alias("similarity"))


def q_edition_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of one text whose keys disagree, against the first of the text."""
    q = _choice(spark, folder).filter("answer is not null").withColumn("body", F.md5(T.canonical_plain(F.col("text"))))
    first = q.groupBy("section", "body").agg(F.min_by(F.struct("id", "answer"), "id").alias("f"))
    return q.join(first, ["section", "body"]).filter("answer <> f.answer").select(F.col("f.id").alias("id_a"), F.col("id").alias("id_b"), F.col("f.answer").alias("answer_a"), F.col("answer").alias("answer_b"))


def q_question_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Tags that the keyword rules give text and explanation."""
    both = F.concat_ws("\n", "text", "explanation")
    return questions(spark, folder).select("id", F.array_join(tags_for(both), ",").alias("tags"))


def q_tag_counts(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def q_flag_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Questions that meet each review pattern."""
    return questions(spark, folder).filter("text is not null").select(F.explode(flags_for(F.col("text"))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def q_review_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Questions with something to look at: patterns met, no key, no explanation, short text."""
    q = questions(spark, folder)
    notes = F.concat(
        F.coalesce(flags_for(F.col("text")), F.array().cast("array<string>")),
        F.array_compact(F.array(F.when((F.col("section") != "pm") & F.col("answer").isNull(), "no key"), F.when(F.coalesce(F.trim("explanation"), F.lit("")) == "", "no explanation"), F.when(F.coalesce(F.length("text"), F.lit(0)) < SHORT, "short"))),
    )
    return q.select("id", F.array_join(notes, "; ").alias("notes")).filter("notes <> ''")


def q_char_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Kanji of the texts with their counts."""
    q = questions(spark, folder).filter("text is not null")
    return q.select(F.explode(F.regexp_extract_all("text", F.lit("[一-鿿]"), F.lit(0))).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))


def q_rare_chars(spark: SparkSession, folder: str) -> DataFrame:
    """Kanji of scanned texts that no explanation has and few sessions do."""
    q = questions(spark, folder)
    kanji = F.lit("[一-鿿]")
    seen = q.filter("text is not null").select("sessionId", F.explode(F.regexp_extract_all("text", kanji, F.lit(0))).alias("ch")).groupBy("ch").agg(F.count_distinct("sessionId").alias("sessions"), F.count("*").alias("n"))
    clean = q.filter("explanation is not null").select(F.explode(F.regexp_extract_all("explanation", kanji, F.lit(0))).alias("ch")).distinct()
    return seen.filter("sessions <= 3").join(clean, "ch", "left_anti")


def q_section_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Questions, cases and papers of each section."""
    q = questions(spark, folder).groupBy("section").agg(F.count("*").alias("questions"))
    c = table(spark, folder, "cases").groupBy(F.coalesce("section", F.lit("pm")).alias("section")).agg(F.count("*").alias("cases"), F.array_join(F.array_sort(F.collect_set("paper")), ",").alias("papers"))  # a section has few papers
    return q.join(c, "section", "left").select("section", "questions", F.coalesce("cases", F.lit(0)).alias("cases"), F.coalesce("papers", F.lit("")).alias("papers"))


def q_session_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Questions by session and section with totals."""
    return questions(spark, folder).rollup("sessionId", "section").agg(F.count("*").alias("n"))


def q_key_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """How often each option is the key, by session."""
    q = questions(spark, folder).filter("answer is not null")
    return q.groupBy("sessionId").pivot("answer", ["ア", "イ", "ウ", "エ"]).agg(F.count("id")).na.fill(0).select("sessionId", F.col("ア").alias("a"), F.col("イ").alias("i"), F.col("ウ").alias("u"), F.col("エ").alias("e"))


def q_explanation_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Shortest, upper median and longest explanation of each session."""
    n = questions(spark, folder).filter("explanation is not null").select("sessionId", F.length("explanation").alias("size")).groupBy("sessionId", "size").agg(F.count("*").alias("c"))
    run = Window.partitionBy("sessionId").orderBy("size")
    total = Window.partitionBy("sessionId")
    placed = n.withColumn("upto", F.sum("c").over(run)).withColumn("all", F.sum("c").over(total))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("size")))
    return placed.groupBy("sessionId").agg(F.min("size").alias("shortest"), middle.alias("median"), F.max("size").alias("longest"))


def q_case_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Cases with a commentary and with a rating, by session."""
    return table(spark, folder, "cases").groupBy("sessionId").agg(F.count("overview").alias("commented"), F.count("overviewRate").alias("rated"))


def q_missing_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers up to the largest that a session's choice section lacks."""
    q = questions(spark, folder).filter("section <> 'pm'")
    want = q.groupBy("sessionId", "section").agg(F.max("qno").alias("top")).select("sessionId", "section", F.explode(F.sequence(F.lit(1), F.col("top"))).alias("qno"))
    return want.join(q.select("sessionId", "section", "qno").distinct(), ["sessionId", "section", "qno"], "left_anti")


def q_repeated_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids that stand in more than one row of questions and cases."""
    ids = table(spark, folder, "questions").select("id").unionAll(table(spark, folder, "cases").select("id"))
    return ids.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def q_corpus_order(spark: SparkSession, folder: str) -> DataFrame:
    """Choice questions by session (year, spring first), section and number, as a place in their session."""
    s = table(spark, folder, "sessions").select(F.col("id").alias("sessionId"), (F.col("exam_year") * 2 + F.when(F.col("term") == "aki", 1).otherwise(0)).cast("long").alias("ordinal"))
    q = questions(spark, folder).select("sessionId", "section", "qno", "id").join(F.broadcast(s), "sessionId")
    return place(q, ["sessionId", "section"], ["qno", "id"]).select("ordinal", "section", "place", "id")


def q_quality_report(spark: SparkSession, folder: str) -> DataFrame:
    """Acceptance rules: (rule, bad rows, severity)."""
    q = questions(spark, folder)
    usable = F.size(F.filter(F.coalesce("choices", F.array().cast("array<struct<key:string,text:string>>")), lambda c: F.trim(F.coalesce(c["text"], F.lit(""))) != ""))
    rules = q.agg(
        F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("text"),
        F.count_if((F.col("section") != "pm") & ~F.coalesce(F.col("answer").isin("ア", "イ", "ウ", "エ"), F.lit(False))).alias("answer"),
        F.count_if(F.coalesce(F.trim("explanation"), F.lit("")) == "").alias("explanation"),
        F.count_if((F.col("section") != "pm") & (usable != OPTIONS)).alias("options"),
        F.count_if(F.coalesce(F.length("text"), F.lit(0)) < SHORT).alias("short"),
        F.count_if(F.coalesce(F.col("text").rlike("[\\x00-\\x08\\x0b-\\x1f\\x7f�]|  "), F.lit(False))).alias("characters"),
    )
    cases = table(spark, folder, "cases").agg(F.count_if(F.coalesce(F.trim("title"), F.lit("")) == "").alias("title"), F.count_if(F.coalesce(F.size("body"), F.lit(0)) <= 0).alias("body"))
    held = q.filter("section = 'pm' and trim(caseId) <> ''").select(F.trim("caseId").alias("id")).join(table(spark, folder, "cases").select("id"), "id", "left_anti").agg(F.count("*").alias("case"))
    ids = q_repeated_ids(spark, folder).agg(F.count("*").alias("ids"))
    out = None
    for df in (rules, cases, held, ids):
        tall = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("bad")) for c in df.columns])).alias("r")).select("r.*")
        out = tall if out is None else out.unionAll(tall)
    return out.withColumn("severity", F.when(F.col("rule").isin("explanation", "short"), "info").otherwise("error"))


_Q = "q AS (SELECT id, any_value(coalesce(section, 'am2')) AS section, any_value(sessionId) AS sessionId, any_value(qno) AS qno, any_value(tags) AS tags, any_value(answer) AS answer, any_value(caseId) AS caseId, any_value(text) AS text, any_value(explanation) AS explanation, any_value(choices) AS choices, any_value(duplicateGroupId) AS g FROM questions WHERE id IS NOT NULL GROUP BY id)"


def _tidy_sql(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace({c}, '[\x00-\x08\x0b-\x1f\x7f]', '', 'g'), chr(12288) || chr(160), '  '), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def _canon_sql(c: str) -> str:
    s = f"translate(lower({c}), '{SMALL[0]}', '{SMALL[1]}')"
    for pattern, new in (("[，、,]", "，"), ("[。．.]", "。"), ("[“”\"''`´‘’（）()〔〕\\[\\]「」【】]", ""), ("[-–—ー−~〜]", ""), (r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", "")):
        s = f"regexp_replace({s}, '{pattern}', '{new}', 'g')"
    return s


def _keyword_sql(c: str, word: str) -> str:
    return f"regexp_matches({c}, '(^|[^A-Za-z0-9]){word}([^A-Za-z0-9]|$)')" if word.isascii() else f"contains({c}, '{word}')"


SMALL = T.SMALL_KANA
_TAGS = ", ".join(f"CASE WHEN {' OR '.join(_keyword_sql('b', w) for w in words)} THEN '{name}' END" for name, words in TAG_RULES)
_FLAG = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{label}' END" for label, p in FLAGS) + "], lambda x: x IS NOT NULL)"
_CHOICE = f"WITH {_Q}, c AS (SELECT id, section, answer, {_canon_sql('text')} AS body, choices FROM q WHERE choices IS NOT NULL AND text IS NOT NULL)"
QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
ORACLE = {
    "clean_texts": f"WITH {_Q} SELECT id, {_tidy_sql('text')} AS cleaned FROM q WHERE text IS NOT NULL",
    "canonical_keys": f"{_CHOICE} SELECT id, substring(sha1(body || '|' || array_to_string(list_transform(choices, lambda x: {_canon_sql('coalesce(x.text, ' + chr(39) * 2 + ')')}), '|')), 1, 12) AS key FROM c",
    "same_text_groups": f"{_CHOICE}, g AS (SELECT id, min(id) OVER w AS head, count(*) OVER w AS size FROM c WHERE answer IS NOT NULL WINDOW w AS (PARTITION BY section, body, answer)) SELECT id, head, size FROM g WHERE size > 1",
    "group_numbers": f"WITH {_Q}, n AS (SELECT g AS duplicateGroupId, count(*) AS size, min(id) AS head FROM q WHERE g IS NOT NULL GROUP BY g HAVING count(*) > 1) SELECT duplicateGroupId, size, 'grp-' || lpad(CAST(row_number() OVER (ORDER BY size DESC, head) AS VARCHAR), 4, '0') AS number FROM n",
    "group_size_histogram": f"WITH {_Q}, n AS (SELECT count(*) AS size FROM q WHERE g IS NOT NULL GROUP BY g) SELECT size, count(*) AS groups FROM n GROUP BY size",
    "unique_count": f'WITH {_Q} SELECT count(*) AS questions, count(*) FILTER (g IS NULL) + count(DISTINCT g) AS "unique" FROM q',
    "edition_conflicts": f"{_CHOICE}, f AS (SELECT section, body, arg_min((id, answer), id) AS f FROM c WHERE answer IS NOT NULL GROUP BY ALL) SELECT f[1] AS id_a, c.id AS id_b, f[2] AS answer_a, answer AS answer_b FROM c JOIN f USING (section, body) WHERE answer <> f[2]",
    "question_tags": f"WITH {_Q}, t AS (SELECT id, list_filter([{_TAGS}], lambda x: x IS NOT NULL) AS t FROM (SELECT id, concat_ws(chr(10), text, explanation) AS b FROM q)) SELECT id, CASE WHEN len(t) > 0 THEN array_to_string(t, ',') ELSE '{FALLBACK}' END AS tags FROM t",
    "tag_counts": f"WITH {_Q}, t AS (SELECT unnest(tags) AS tag FROM q) SELECT tag, count(*) AS n FROM t GROUP BY tag",
    "flag_counts": f"WITH {_Q}, t AS (SELECT unnest({_FLAG}) AS label FROM q WHERE text IS NOT NULL) SELECT label, count(*) AS n FROM t GROUP BY label",
    "review_notes": f"WITH {_Q}, n AS (SELECT id, array_to_string(list_concat(CASE WHEN text IS NULL THEN [] ELSE {_FLAG} END, list_filter([CASE WHEN section <> 'pm' AND answer IS NULL THEN 'no key' END, CASE WHEN coalesce(trim(explanation), '') = '' THEN 'no explanation' END, CASE WHEN coalesce(length(text), 0) < 100 THEN 'short' END], lambda x: x IS NOT NULL)), '; ') AS notes FROM q) SELECT id, notes FROM n WHERE notes <> ''",
    "char_counts": f"WITH {_Q}, t AS (SELECT unnest(regexp_extract_all(text, '[一-鿿]')) AS ch FROM q WHERE text IS NOT NULL) SELECT ch, count(*) AS n FROM t GROUP BY ch",
    "rare_chars": f"WITH {_Q}, t AS (SELECT sessionId, unnest(regexp_extract_all(text, '[一-鿿]')) AS ch FROM q WHERE text IS NOT NULL), e AS (SELECT unnest(regexp_extract_all(explanation, '[一-鿿]')) AS ch FROM q WHERE explanation IS NOT NULL) SELECT ch, count(DISTINCT sessionId) AS sessions, count(*) AS n FROM t WHERE ch NOT IN (SELECT ch FROM e) GROUP BY ch HAVING count(DISTINCT sessionId) <= 3",
    "section_counts": f"WITH {_Q}, a AS (SELECT section, count(*) AS questions FROM q GROUP BY section), c AS (SELECT coalesce(section, 'pm') AS section, count(*) AS cases, array_to_string(list_sort(list(DISTINCT paper)), ',') AS papers FROM cases GROUP BY 1) SELECT a.section, questions, coalesce(cases, 0) AS cases, coalesce(papers, '') AS papers FROM a LEFT JOIN c ON a.section = c.section",
    "session_rollup": f"WITH {_Q} SELECT sessionId, section, count(*) AS n FROM q GROUP BY ROLLUP (sessionId, section)",
    "key_histogram": f"WITH {_Q} SELECT sessionId, count(*) FILTER (answer = 'ア') AS a, count(*) FILTER (answer = 'イ') AS i, count(*) FILTER (answer = 'ウ') AS u, count(*) FILTER (answer = 'エ') AS e FROM q WHERE answer IS NOT NULL GROUP BY sessionId",
    "explanation_lengths": f"WITH {_Q} SELECT sessionId, min(length(explanation)) AS shortest, list_sort(list(length(explanation)))[count(*) // 2 + 1] AS median, max(length(explanation)) AS longest FROM q WHERE explanation IS NOT NULL GROUP BY sessionId",
    "case_rates": "SELECT sessionId, count(overview) AS commented, count(overviewRate) AS rated FROM cases GROUP BY sessionId",
    "missing_numbers": f"WITH {_Q}, w AS (SELECT sessionId, section, unnest(range(1, max(qno) + 1)) AS qno FROM q WHERE section <> 'pm' GROUP BY sessionId, section) SELECT sessionId, section, CAST(qno AS INTEGER) AS qno FROM w WHERE (sessionId, section, qno) NOT IN (SELECT (sessionId, section, CAST(qno AS BIGINT)) FROM q WHERE section <> 'pm')",
    "repeated_ids": "SELECT id, count(*) AS n FROM (SELECT id FROM questions UNION ALL SELECT id FROM cases) GROUP BY id HAVING count(*) > 1",
    "corpus_order": f"WITH {_Q} SELECT CAST(exam_year * 2 + (term = 'aki')::INT AS BIGINT) AS ordinal, section, row_number() OVER (PARTITION BY sessionId, section ORDER BY qno, q.id) AS place, q.id FROM q JOIN sessions s ON s.id = q.sessionId",
    "quality_report": rf"""WITH {_Q}, r AS (
  SELECT 'text' AS rule, count(*) FILTER (coalesce(trim(text), '') = '') AS bad FROM q
  UNION ALL SELECT 'answer', count(*) FILTER (section <> 'pm' AND NOT coalesce(answer IN ('ア', 'イ', 'ウ', 'エ'), false)) FROM q
  UNION ALL SELECT 'explanation', count(*) FILTER (coalesce(trim(explanation), '') = '') FROM q
  UNION ALL SELECT 'options', count(*) FILTER (section <> 'pm' AND len(list_filter(coalesce(choices, []), lambda c: trim(coalesce(c.text, '')) <> '')) <> 4) FROM q
  UNION ALL SELECT 'short', count(*) FILTER (coalesce(length(text), 0) < 100) FROM q
  UNION ALL SELECT 'characters', count(*) FILTER (coalesce(regexp_matches(text, '[\x00-\x08\x0b-\x1f\x7f\x{{FFFD}}]|  '), false)) FROM q
  UNION ALL SELECT 'title', count(*) FILTER (coalesce(trim(title), '') = '') FROM cases
  UNION ALL SELECT 'body', count(*) FILTER (coalesce(len(body), 0) = 0) FROM cases
  UNION ALL SELECT 'case', count(*) FROM q WHERE section = 'pm' AND trim(caseId) <> '' AND trim(caseId) NOT IN (SELECT id FROM cases)
  UNION ALL SELECT 'ids', count(*) FROM (SELECT id FROM (SELECT id FROM questions UNION ALL SELECT id FROM cases) GROUP BY id HAVING count(*) > 1))
SELECT rule, bad, CASE WHEN rule IN ('explanation', 'short') THEN 'info' ELSE 'error' END AS severity FROM r""",
}
