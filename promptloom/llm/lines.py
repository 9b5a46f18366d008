"""Line dedup by a log-template tree, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.common import write_table
from promptloom.llm.keyed import keyed_docs

#: Tokens that lead to a leaf; documents in which a generalised template must occur; tokens from which on a line is long; per cent
#: of a template's tokens that must be fixed.
LEADING, MIN_DOCS, MIN_TOKENS, FIXED = 3, 3, 4, 70
#: Documents in which an exact or masked line must occur, from MIN_TOKENS tokens on and below.
TWICE, SHORT_DOCS = 2, 3
FIELD = "<*>"
#: Leaves (8 bytes each) up to which they are sent to all executors; more are joined by a shuffle.
BROADCAST_LEAVES = 1_000_000


def _lines(rows: DataFrame) -> DataFrame:
    """key, line_no, c (the line with single spaces between its tokens and none around), n (tokens)."""
    text = F.col("text")
    text = F.when(text.contains("  ") | text.rlike(r"[\t\x0b\f\r]"), F.regexp_replace(text, r"[ \t\x0b\f\r]+", " ")).otherwise(text)
    lines = rows.select("key", F.posexplode(F.split(text, "\n")).alias("line_no", "line")).select("key", "line_no", F.trim("line").alias("c"))
    return lines.withColumn("n", F.char_length("c") - F.char_length(F.replace(F.col("c"), F.lit(" "), F.lit(""))) + 1)


def _masked(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), F.regexp_replace(c, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(c)


def _leaf(form: Column) -> Column:
    return F.xxhash64("n", F.substring_index(form, " ", LEADING))


def _words(form: Column) -> Column:
    """Tokens of a form that are not fields."""
    return F.when(form.contains(FIELD), F.size(F.array_remove(F.split(form, " "), FIELD))).otherwise(F.col("n"))


def _parsed(rows: DataFrame) -> DataFrame:
    """key, line_no, form (the line with its variable fields masked), n (tokens), leaf of the lines that have MIN_TOKENS tokens, or
    fewer and a letter or digit. Short lines, and those in which fields leave under FIXED % of words, are in no leaf; the latter
    stay unmasked."""
    lines, long = _lines(rows), F.col("n") >= MIN_TOKENS
    lines = lines.where(long | F.col("c").rlike(r"[\p{L}\p{N}]")).withColumn("form", _masked(F.col("c")))
    lines = lines.withColumn("enough", 100 * _words(F.col("form")) >= FIXED * F.col("n"))
    form, leaf = F.when(F.col("enough"), F.col("form")).otherwise(F.col("c")), F.when(F.col("enough") & long, _leaf(F.col("form")))
    return lines.select("key", "line_no", "n", form.alias("form"), leaf.alias("leaf"))


def _in_documents(lines: DataFrame, by: str, least: int) -> DataFrame:
    """by, first (the smallest key) of what at least so many documents have; counted by document before the shuffle."""
    return lines.select(by, "key").distinct().groupBy(by).agg(F.min("key").alias("first"), F.count("*").alias("docs")).where(F.col("docs") >= least).drop("docs")


def _small(leaves: DataFrame) -> DataFrame:
    return F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves


def _mixed_leaves(narrow: DataFrame) -> DataFrame:
    """The leaves that have several forms, in MIN_DOCS or more documents."""
    ends = narrow.groupBy("leaf").agg(*(f(c).alias(f"{k}_{c}") for k, f in (("lo", F.min), ("hi", F.max)) for c in ("form", "key")))
    several = write_table(ends.where("lo_form <> hi_form and lo_key <> hi_key").select("leaf"), "leaves")
    return write_table(_in_documents(narrow.join(_small(several), "leaf", "left_semi"), "leaf", MIN_DOCS).select("leaf"), "leaves")


def _forms(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """form (its hash), leaf, n, m (words), tokens of each form in these leaves, once. Only leading tokens are masked before the
    leaves are known."""
    lines = _lines(rows).where(F.col("n") >= MIN_TOKENS).withColumn("leaf", _leaf(_masked(F.substring_index("c", " ", LEADING))))
    lines = lines.join(leaves, "leaf", "left_semi").select("leaf", "n", _masked(F.col("c")).alias("text"))
    lines = lines.select(F.xxhash64("text").alias("form"), "leaf", "n", "text").dropDuplicates(["form"])
    forms = write_table(lines.select("form", "leaf", "n", _words(F.col("text")).alias("m"), F.split("text", " ").alias("tokens")), "forms")
    return forms.where(100 * F.col("m") >= FIXED * F.col("n"))


def _support(of: DataFrame, owners: DataFrame, *by: str) -> DataFrame:
    """by, first, docs: the documents that have a form of which `of` (form, by) tells something.

    A document with one form in a leaf is counted with all others of that form, once for each; only those with several are told
    apart."""
    alone = owners.where("forms = 1").groupBy("form").agg(F.min("key").alias("first"), F.count("*").alias("docs"))
    alone = of.join(alone, "form").groupBy(*by).agg(F.min("first").alias("first"), F.sum("docs").alias("docs"))
    others = of.join(owners.where("forms > 1").select("form", "key"), "form").select(*by, "key").distinct()
    others = others.groupBy(*by).agg(F.min("key").alias("first"), F.count("*").alias("docs"))
    return alone.unionByName(others).groupBy(*by).agg(F.min("first").alias("first"), F.sum("docs").alias("docs"))


def _template_words(forms: DataFrame, owners: DataFrame) -> DataFrame:
    """form, template (a hash of leaf and fixed words) of each way to leave words of a form open that may recur.

    A word is fixed by its place. Words that under MIN_DOCS documents of the leaf have at their place are open in every way;
    then the rarest of the others, one more step of support each time, and besides each single word of a line that has no rare ones. Fields are open
    always; the fixed words are at least FIXED % of the tokens. Support counts documents and has no share in it, so other lines
    of a leaf can't outvote a template.
    """
    words = forms.select("form", "leaf", "n", "m", F.posexplode("tokens").alias("at", "token")).where(F.col("token") != FIELD)
    words = words.select("form", "leaf", "n", "m", F.xxhash64("at", "token").alias("word"))
    support = _support(words.select("form", "leaf", "word"), owners, "leaf", "word").where(F.col("docs") >= MIN_DOCS).drop("first")
    line = Window.partitionBy("form")
    down = line.orderBy(F.desc("docs"))  # words of equal support are taken at once
    both = {"all": line, "top": down}
    words = words.join(support, ["leaf", "word"])
    words = words.select("*", *(F.count("*").over(w).alias(f"n_{k}") for k, w in both.items()), *(F.bit_xor("word").over(w).alias(k) for k, w in both.items()))
    enough = lambda c: 100 * c >= FIXED * F.col("n")
    one_open = F.when((F.col("n_all") == F.col("m")) & enough(F.col("n_all") - 1), F.xxhash64("leaf", F.col("all").bitwiseXOR(F.col("word"))))
    rest_open = F.when(enough(F.col("n_top")), F.xxhash64("leaf", "top"))
    return words.select("form", F.explode(F.array(one_open, rest_open)).alias("template")).where("template is not null").distinct()


def _by_template(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """form, first: for each template of a form that MIN_DOCS documents have, the first of them."""
    leaves = _small(_mixed_leaves(narrow))
    owners = narrow.join(leaves, "leaf", "left_semi").select("leaf", "form", "key").distinct()
    owners = write_table(owners.select("form", "key", F.count("*").over(Window.partitionBy("leaf", "key")).alias("forms")), "owners")
    found = write_table(_template_words(_forms(rows, leaves), owners), "templates")
    again = _support(found, owners, "template").where(F.col("docs") >= MIN_DOCS)
    return found.join(again, "template").select("form", "first")


def recurring_lines(rows: DataFrame) -> DataFrame:
    """key, line_no of the lines to drop from rows (key, text).

    Two scans: the first leaves narrow rows of hashes, which tell the leaves and the exact or masked lines that recur; the second
    takes the forms of leaves with several, each once, of which every template that occurs in MIN_DOCS documents is found."""
    narrow = write_table(_parsed(rows).select("key", "line_no", "leaf", F.xxhash64("form").alias("form"), (F.col("n") < MIN_TOKENS).alias("short")), "lines")
    # the smallest and the largest key tell whether TWICE documents have it
    twice = narrow.where("not short").groupBy("form").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first <> last").drop("last")
    firsts = twice.unionByName(_in_documents(narrow.where("short"), "form", SHORT_DOCS)).unionByName(_by_template(rows, narrow.where("leaf is not null")))
    rules = firsts.groupBy("form").agg(F.min("first").alias("lo"), F.max("first").alias("hi"))
    return narrow.join(rules, "form").where("key <> lo or key <> hi").select("key", "line_no")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, doc_id, n_lines, n_dropped, text (what is kept) for each row of docs; key as in keyed_docs.

    Lines (between line feeds) are parsed by a tree of fixed depth: token count, then LEADING leading tokens, tokens with digits
    taken as variable fields. A line's templates are its masked form and, within its leaf, the generalised ones that leave some of
    its words open (_template_words): a leaf may have any number of these, each found by the documents that have it, so other
    lines can't hide one. A line is dropped from all but the first document (the smallest id) that has its template: exact or
    masked ones of MIN_TOKENS tokens or more in TWICE documents, shorter ones in SHORT_DOCS, generalised ones in MIN_DOCS. Fields
    are no fixed words: a line in which they leave under FIXED % of words recurs by its unmasked text only.

    Null and empty texts have one empty line and stay so; a text loses whole lines only; rows with repeated or null ids are told
    apart and keep the order of ids; an empty table gives no rows; other columns are ignored.
    """
    rows = keyed_docs(docs, id_col, text_col)
    drop = recurring_lines(rows).groupBy("key").agg(F.array_sort(F.collect_set("line_no")).alias("drop"))
    out = rows.join(drop, "key", "left").withColumn("lines", F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return out.select("key", "doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.array_size("drop"), F.lit(0)).cast("long").alias("n_dropped"), text.alias("text"))
