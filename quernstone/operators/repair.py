"""Repair of texts by rules and reference data: corrections, split words, voted spellings, overrides, frames and markers."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from quernstone.functions import text as T
from quernstone.operators.study import questions
from quernstone.session import table

#: Votes: how rare the odd spelling, and how many times as frequent the common one must be.
ODD, TIMES = 5, 10
#: Marks at which a line end cuts a word.
MARKS = "-‐‑‒–—−¬\u00ad⁃"


def rejoined(pattern: str, repl: str) -> str:
    """A pattern of several lines as it was before line ends, page numbers and running headers cut it: the form most like its replacement."""
    lines = [x.strip() for x in pattern.split("\n") if x.strip()]
    forms = ["".join(x.rstrip(MARKS) if k < len(lines) - 1 else x for k, x in enumerate(lines)), "".join(lines), *lines]
    alike = lambda x: difflib.SequenceMatcher(None, re.sub(r"\(\?[^()]*\)", "", x), repl, autojunk=False).ratio()
    return max(forms, key=alike)


def usable_rules(spark: SparkSession, folder: str) -> list[tuple[int, str, str]]:
    """Correction rules (ord, pattern, repl) in order: repeated patterns once, invalid ones left out. The table does not grow.

    A pattern of several lines counts as written, for texts cut at the same place, and then rejoined.
    """
    out, seen = [], set()
    for r in table(spark, folder, "corrections").filter("ord is not null").orderBy("ord").collect():
        repl = r["repl"] or ""
        whole = r["pattern"] or ""
        for pattern in [whole, rejoined(whole, repl)] if "\n" in whole.strip() else [whole]:
            if not pattern or pattern in seen:
                continue
            try:
                re.compile(pattern).sub(repl, "")
            except (re.error, IndexError):
                continue
            seen.add(pattern)
            out.append((r["ord"], pattern, repl))
    return out


def apply_rules(s: Column, rules: list[tuple[int, str, str]]) -> Column:
    """Ordered regular-expression replacements, patterns and replacements in Python's syntax."""

    @F.pandas_udf(StringType())
    def corrected(texts):  # noqa: ANN001, ANN202
        compiled = [(re.compile(pattern), repl) for _, pattern, repl in rules]

        def one(t: str | None) -> str | None:
            if t:
                for pattern, repl in compiled:
                    t = pattern.sub(repl, t)
            return t

        return texts.map(one)

    return corrected(s)


def q_corrected_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that the correction rules change (all valid rules, in order)."""
    rules = usable_rules(spark, folder)
    return questions(spark, folder).filter("text is not null").select("id", F.col("text").alias("before"), apply_rules(F.col("text"), rules).alias("after")).filter("before <> after").select("id", "after")


def q_pattern_hits(spark: SparkSession, folder: str) -> DataFrame:
    """How many texts each valid rule matches, regular expressions and patterns of several lines included; rules without a match are left out."""
    rules = usable_rules(spark, folder)

    def count(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        hits: dict[int, int] = {}
        for pdf in batches:
            for ord_, pattern, _ in rules:
                n = sum(1 for t in pdf["text"] if re.search(pattern, t))
                hits[ord_] = hits.get(ord_, 0) + n
        yield pd.DataFrame({"ord": pd.Series(list(hits), dtype="int32"), "hits": pd.Series(list(hits.values()), dtype="int64")})

    # a row for each rule and task: a text that a rule's forms match twice counts for each
    partial = questions(spark, folder).filter("text is not null").select("text").mapInPandas(count, "ord int, hits long")
    return partial.groupBy("ord").agg(F.sum("hits").alias("hits")).filter("hits > 0")


def q_rule_hits(spark: SparkSession, folder: str) -> DataFrame:
    """How many texts hold each plain rule's pattern."""
    rules = table(spark, folder, "corrections").filter(~F.col("pattern").rlike(r"[\n()\[\]|+?\\]")).select("ord", "pattern")
    q = questions(spark, folder).filter("text is not null").select("text")
    return q.join(F.broadcast(rules), F.expr("contains(text, pattern)")).groupBy("ord").agg(F.count("*").alias("hits"))  # a fixed table of rules


def q_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Words of five and more letters of the explanations."""
    q = questions(spark, folder).filter("explanation is not null")
    return q.select(F.explode(F.regexp_extract_all("explanation", F.lit("[A-Za-z][A-Za-z0-9]{4,}"), F.lit(0))).alias("w")).select(F.lower("w").alias("word")).distinct()


def q_rejoined_words(spark: SparkSession, folder: str) -> DataFrame:
    """Two Latin pieces with a blank between that are one word of the vocabulary."""
    pairs = F.regexp_extract_all("text", F.lit("(?=(?<![A-Za-z])([A-Za-z]{2,} [A-Za-z]{1,7})(?![A-Za-z]))"), F.lit(1))
    met = questions(spark, folder).filter("text is not null").select("id", F.explode(pairs).alias("pieces")).withColumn("word", F.lower(F.replace("pieces", F.lit(" "), F.lit(""))))
    return met.join(q_vocabulary(spark, folder), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))


def vote_terms(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(odd, common): rare tokens one substitution from exactly one token ten times as frequent; tokens: (token, n); lexicon: (token).

    Candidates meet on the token with one place left open, so no pair is formed that is not one substitution apart.
    """
    keyed = tokens.filter("length(token) between 3 and 24").withColumn("key", F.explode(F.expr("transform(sequence(1, length(token)), i -> concat(substring(token, 1, i - 1), '?', substring(token, i + 1), '#', i))")))
    odd = keyed.filter(F.col("n") <= ODD).join(lexicon, "token", "left_anti").select(F.col("token").alias("odd"), F.col("n").alias("odd_n"), "key")
    common = keyed.filter(F.col("n") >= TIMES).select(F.col("token").alias("common"), F.col("n").alias("common_n"), "key")
    met = odd.join(common, "key").filter("odd <> common and common_n >= 10 * odd_n").select("odd", "common").distinct()
    return met.groupBy("odd").agg(F.count("*").alias("k"), F.min("common").alias("common")).filter("k = 1").select("odd", "common")


def q_voted_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Spellings of katakana words that the corpus votes down."""
    kana = F.lit("[ァ-ヺー]{3,}")
    q = questions(spark, folder)
    tokens = q.filter("text is not null").select(F.explode(F.regexp_extract_all("text", kana, F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    lexicon = q.filter("explanation is not null").select(F.explode(F.regexp_extract_all("explanation", kana, F.lit(0))).alias("token")).distinct()
    return vote_terms(tokens, lexicon)


def q_fixed_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions with their latest fix: text replaced, choices of the fix over the own ones, figure dropped on request."""
    fixes = table(spark, folder, "am_fixes").filter("id is not null")
    latest = fixes.groupBy("id").agg(F.max_by(F.struct("text", F.map_entries("choices").alias("choices"), "dropFigure"), F.struct("fixed_at", "fix_key")).alias("f"))
    q = questions(spark, folder).join(latest, "id")
    own = F.coalesce("choices", F.array().cast("array<struct<key:string,text:string>>"))
    given = F.coalesce("f.choices", F.array().cast("array<struct<key:string,value:string>>"))
    merged = F.transform(own, lambda c: F.coalesce(F.get(F.filter(given, lambda g: g["key"] == c["key"]), F.lit(0))["value"], c["text"]))
    return q.select("id", F.coalesce("f.text", "text").alias("text"), F.array_join(merged, "|").alias("options"), F.when(F.col("f.dropFigure"), 0).otherwise(F.size("figures")).alias("n_figures"))


def q_unmatched_fixes(spark: SparkSession, folder: str) -> DataFrame:
    """Fixes for which no question is there."""
    return table(spark, folder, "am_fixes").join(questions(spark, folder).select("id"), "id", "left_anti").select("fix_key", "id")


def q_bracket_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with more closing than opening brackets."""
    q = questions(spark, folder).filter("text is not null")
    return q.select("id", T.bracket_gaps(F.col("text"), "（(", "）)").cast("long").alias("round"), T.bracket_gaps(F.col("text"), "〔［", "〕］").cast("long").alias("square")).filter("round > 0 or square > 0")


@F.pandas_udf(StringType())
def restore_openers(text, reference):  # noqa: ANN001, ANN202
    """Texts with the opening brackets that a second reading shows and that they lack, as many as closers need."""
    import pandas as pd

    classes = ("（(", "）)"), ("〔［「", "〕］」")

    def one(a: str | None, b: str | None) -> str | None:
        if not a or not b:
            return a
        lack = {o: max(0, sum(a.count(c) for c in closes) - sum(a.count(c) for c in o)) for o, closes in classes}
        if not any(lack.values()):
            return a
        at = [i for i, c in enumerate(a) if not c.isspace()]
        mine, other = [a[i] for i in at], [c for c in b if not c.isspace()]
        adds = []
        for op, i1, _, j1, j2 in difflib.SequenceMatcher(None, mine, other, autojunk=False).get_opcodes():
            if op == "insert":
                for c in other[j1:j2]:
                    o = next((k for k in lack if c in k and lack[k] > 0), None)
                    if o:
                        adds.append((at[i1] if i1 < len(at) else len(a), c))
                        lack[o] -= 1
        for i, c in sorted(adds, reverse=True):
            keep = i - 1 if i and a[i - 1] in " \n" else i
            a = a[:keep] + c + a[i:]
        return a

    return pd.Series([one(x, y) for x, y in zip(text, reference)])


def q_restored_brackets(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose lines lack openers that the second reading has."""
    p = table(spark, folder, "ocr_pages").filter("tesseract is not null").select("file", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("own"), "tesseract").distinct()
    return p.select("file", "own", restore_openers("own", "tesseract").alias("text")).filter("own <> text").select("file", "text")


#: A frame around a label or nothing.
_FRAME = re.compile(r"［[\s　]*([^［］]{0,3}?)[\s　]*］")


def repair_frames(text: str, labels: list[str]) -> str:
    """Frames with the label they stand for, by the case's own labels.

    A frame's reading is folded (width, letter case, look-alikes); it is replaced if it meets exactly one label. A single empty frame takes
    the only label no other frame shows. Anything else stays as it is.
    """
    import unicodedata

    fold = lambda s: unicodedata.normalize("NFKC", s).lower().translate(str.maketrans("0169", "oibg"))
    known = {}
    for label in labels:
        known.setdefault(fold(label), []).append(label)
    seen: set[str] = set()

    def name(m: re.Match) -> str:
        met = known.get(fold(m[1]), [])
        if m[1] and len(met) == 1:
            seen.add(met[0])
            return f"［　{met[0]}　］"
        return m[0]

    text = _FRAME.sub(name, text)
    free = [x for x in dict.fromkeys(labels) if x not in seen]
    empty = [m for m in _FRAME.finditer(text) if not m[1].strip()]
    if len(free) == 1 and len(empty) == 1:
        m = empty[0]
        text = f"{text[: m.start()]}［　{free[0]}　］{text[m.end() :]}"
    return text


def repair_wording(text: str, labels: list[str]) -> str:
    """A question's wording repaired by its labels, rule after rule; a rule acts only where one reading is possible.

    1. A closing frame that nothing opened goes. 2. A box cut in two around one label is joined. 3. A damaged range between two frames
    spans the first and the last label. 4. Frames take their labels. 5. Blanks between a frame and Japanese text close up.
    """
    depth, kept = 0, []
    for c in text:
        if c == "］" and depth == 0:
            continue
        depth += (c == "［") - (c == "］")
        depth = max(depth, 0)
        kept.append(c)
    text = "".join(kept)

    def box(m: re.Match) -> str:
        met = [x for x in labels if x.lower() == m[1].lower()]
        return f"［{met[0]}］" if len(met) == 1 else m[0]

    text = re.sub(r"［[\s　]*］\s*([A-Za-zア-ン])\s*［[\s　]*］", box, text)
    if len(labels) > 2:
        text = re.sub(r"［[\s　]*([^［］]{0,2})[\s　]*］\s*[~〜～ー－-]\s*［[\s　]*([^［］]{0,2})[\s　]*］", lambda m: f"［　{labels[0]}　］～［　{labels[-1]}　］" if (m[1].strip() in labels) != (m[2].strip() in labels) else m[0], text, count=1)
    text = repair_frames(text, labels)
    return re.sub(r"(?<=］)[ 　]+(?=[^\x00-\x7f［])|(?<=[^\x00-\x7f］])[ 　]+(?=［)", "", text)


@F.pandas_udf(StringType())
def repaired_frames(text, labels):  # noqa: ANN001, ANN202
    """`repair_wording` of each text with its labels."""
    import pandas as pd

    return pd.Series([None if t is None else repair_wording(t, [x for x in (ls if ls is not None else []) if x]) for t, ls in zip(text, labels)])


def q_framed_blanks(spark: SparkSession, folder: str) -> DataFrame:
    """Written questions with frames, repaired by the labels of their case."""
    cases = table(spark, folder, "cases").select(F.col("id").alias("case_id"), "blanks")
    q = questions(spark, folder).filter("text like '%［%' and caseId is not null").select("id", F.trim("caseId").alias("case_id"), "text")
    return q.join(cases, "case_id").select("id", repaired_frames("text", "blanks").alias("text"))


def q_blank_order(spark: SparkSession, folder: str) -> DataFrame:
    """Missing labels of each case: letters between its first and last that it does not list."""
    c = table(spark, folder, "cases").filter("size(blanks) > 0").select("id", F.explode("blanks").alias("label")).filter("label rlike '^[a-z]$'").distinct()
    ends = c.groupBy("id").agg(F.min(F.ascii("label")).alias("lo"), F.max(F.ascii("label")).alias("hi"))
    every = ends.select("id", F.explode(F.sequence("lo", "hi")).alias("code")).withColumn("label", F.char("code"))
    return every.join(c, ["id", "label"], "left_anti").select("id", "label")


def q_label_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of consecutive labels of each case: first, last and number."""
    c = table(spark, folder, "cases").select("id", F.explode("blanks").alias("label")).filter("label rlike '^[a-z]$'").distinct().withColumn("code", F.ascii("label"))
    island = F.col("code") - F.row_number().over(Window.partitionBy("id").orderBy("code"))
    return c.withColumn("island", island).groupBy("id", "island").agg(F.min("label").alias("first"), F.max("label").alias("last"), F.count("*").alias("n")).drop("island")


_Q = "q AS (SELECT id, any_value(text) AS text, any_value(explanation) AS explanation, any_value(choices) AS choices, any_value(figures) AS figures FROM questions WHERE id IS NOT NULL GROUP BY id)"
_HOLE = "unnest(list_transform(range(1, length(token) + 1), lambda i: substring(token, 1, i - 1) || '?' || substring(token, i + 1) || '#' || i))"
QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
ORACLE = {
    "rule_hits": f"WITH {_Q}, r AS (SELECT ord, pattern FROM corrections WHERE NOT regexp_matches(pattern, '[\\n()\\[\\]|+?\\\\]')) SELECT ord, count(*) AS hits FROM q JOIN r ON contains(text, pattern) GROUP BY ord",
    "vocabulary": f"WITH {_Q} SELECT DISTINCT lower(unnest(regexp_extract_all(explanation, '[A-Za-z][A-Za-z0-9]{{4,}}'))) AS word FROM q WHERE explanation IS NOT NULL",
    "voted_terms": f"WITH {_Q}, w AS (SELECT unnest(regexp_extract_all(text, '[ァ-ヺー]{{3,}}')) AS token FROM q WHERE text IS NOT NULL), t AS (SELECT token, count(*) AS n FROM w GROUP BY token HAVING length(token) BETWEEN 3 AND 24), x AS (SELECT unnest(regexp_extract_all(explanation, '[ァ-ヺー]{{3,}}')) AS token FROM q WHERE explanation IS NOT NULL), k AS (SELECT token, n, {_HOLE} AS key FROM t), o AS (SELECT token AS odd, n AS odd_n, key FROM k WHERE n <= 5 AND token NOT IN (SELECT token FROM x)), c AS (SELECT token AS common, n AS common_n, key FROM k WHERE n >= 10), m AS (SELECT DISTINCT odd, common FROM o JOIN c USING (key) WHERE odd <> common AND common_n >= 10 * odd_n) SELECT odd, min(common) AS common FROM m GROUP BY odd HAVING count(*) = 1",
    "fixed_questions": f"WITH {_Q}, f AS (SELECT id, arg_max(struct_pack(text := text, choices := choices, drop := dropFigure), (fixed_at, fix_key)) AS f FROM am_fixes WHERE id IS NOT NULL GROUP BY id) SELECT id, coalesce(f.text, q.text) AS text, array_to_string(list_transform(coalesce(q.choices, []), lambda c: coalesce(f.choices[c.key], c.text)), '|') AS options, CASE WHEN f.drop THEN 0 ELSE CAST(len(figures) AS INT) END AS n_figures FROM q JOIN f USING (id)",
    "unmatched_fixes": "SELECT fix_key, id FROM am_fixes WHERE id NOT IN (SELECT id FROM questions WHERE id IS NOT NULL)",
    "blank_order": "WITH c AS (SELECT DISTINCT id, unnest(blanks) AS label FROM cases), l AS (SELECT * FROM c WHERE regexp_matches(label, '^[a-z]$')), e AS (SELECT id, chr(CAST(unnest(range(min(ascii(label)), max(ascii(label)) + 1)) AS INT)) AS label FROM l GROUP BY id) SELECT id, label FROM e WHERE (id, label) NOT IN (SELECT (id, label) FROM l)",
    "label_runs": "WITH c AS (SELECT DISTINCT id, unnest(blanks) AS label FROM cases), l AS (SELECT *, ascii(label) - row_number() OVER (PARTITION BY id ORDER BY label) AS island FROM c WHERE regexp_matches(label, '^[a-z]$')) SELECT id, min(label) AS first, max(label) AS last, count(*) AS n FROM l GROUP BY id, island",
}
