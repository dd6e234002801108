"""Line dedup by a log-template tree, in DataFrame functions only.

A line descends a tree of fixed depth: its number of tokens, then its first DEPTH tokens; a token with a digit is a
variable field and counts as `<*>` throughout. Two kinds of template hang on a leaf:

* the masked line itself, and
* the leaf's general form: per position the most frequent token where at least half of the leaf's lines have it
  (ties: the smaller token), else `<*>`. A line is an instance if it has the form's token in at least SIMILAR of all
  positions.

A template with instances in at least min_docs documents is boilerplate. It stays in the document with the smallest
doc_id and goes from all others. With whole=True two more kinds of line recur: a long line (LONG tokens, or as many
characters of scripts without spaces) from its second document on, compared as it is but for the white space between
tokens, and lines of one or two tokens, at min_docs. A leaf then holds any number of templates besides its general form: a
line's template keeps the first DEPTH tokens and, of the others, those that most lines of the leaf have in their place, as
many as SIMILAR asks for; a token that fewer than min_docs lines have there is a variable field. Counts cover all documents; they are combined before each shuffle, and only
(document, line number, hash) rows travel for all lines. Texts are dealt by document twice: to read the lines in
recurring leaves, and to drop lines. The join is told to shuffle, since what it meets grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import met, quoted, spare, stash

DEPTH, MIN_TOKENS, SIMILAR = 3, 3, 0.7
LONG = 50
_SPACED = r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]+"
_SPACE = r"[ \t\x0B\f\r]"
_NOT_FIRST = "first is null or doc_id is null or doc_id <> first"


def _split(line):
    """Tokens of a line as they are; one empty token where it has none."""
    return F.split(F.trim(line, F.lit(" \t\x0b\f\r")), _SPACE + "+")


def _tokens(line):
    """Masked tokens of a line. A field is looked for where a token begins only, so that long tokens take linear time."""
    field = r"(?<![^ \t\x0B\f\r])[^ \t\x0B\f\r0-9]*+[0-9][^ \t\x0B\f\r]*+"
    return _split(F.when(line.rlike("[0-9]"), F.regexp_replace(line, field, "<*>")).otherwise(line))


def _fields(rows: DataFrame, *columns: str, whole: bool) -> DataFrame:
    """rows with their line's tokens as t. A short line of variable fields only says nothing once masked: whole keeps
    its tokens as they are."""
    rows = rows.select(*columns, "line", _tokens(F.col("line")).alias("t"))
    if whole:
        bare = F.lit(False)
        for n in range(1, MIN_TOKENS):
            bare = bare | (F.col("t") == F.array(*[F.lit("<*>")] * n))
        rows = rows.select(*columns, "line", F.when(bare, _split(F.col("line"))).otherwise(F.col("t")).alias("t"))
    return rows


def _long(line, tokens, long: int):
    """A line of so many tokens, or so many characters of scripts without spaces, which take three bytes or more each."""
    marks = F.octet_length(line) - F.length(line)
    return (F.size(tokens) >= long) | ((marks >= 2 * long) & (F.length(F.regexp_replace(line, _SPACED, "")) >= long))


def _leaf(tokens):
    return F.xxhash64(F.size(tokens), F.slice(tokens, 1, DEPTH))


def _recurring(rows: DataFrame, keys: list[str], min_docs: int) -> DataFrame:
    """Keys in at least min_docs documents, how many lines have them, and the smallest doc_id that has one."""
    return (
        rows.groupBy(*keys, "doc", "doc_id").agg(F.count("*").alias("rows"))
        .groupBy(*keys).agg(F.count("*").alias("docs"), F.sum("rows").alias("rows"), F.min("doc_id").alias("first"))
        .where(F.col("docs") >= min_docs).drop("docs")
    )


def _templates(held: DataFrame, forms: DataFrame, votes: DataFrame, min_docs: int, total: int) -> DataFrame:
    """held, of total rows at most, with the template of each line that has one.

    Lines with the same kept tokens rank them alike, so two lines that share more tokens than are needed, all frequent
    ones, share the needed ones too: one key a line is enough.
    """
    named = forms.select("leaf", F.xxhash64("t").alias("form"), "t", F.col("n").alias("rows"))
    places = named.select("leaf", "form", F.posexplode("t").alias("p", "token"))
    free = lambda d: d.where((F.col("p") >= DEPTH) & (F.col("token") != "<*>"))
    frequent = free(votes).where(F.col("n") >= min_docs)
    n_places = named.agg(F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("n")).first().n
    some = (
        met(free(places), frequent, ["leaf", "p", "token"], "forms", n_places)
        .groupBy("leaf", "form").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "p", "token"))).alias("kept"))
    )
    kept = named.drop("t").join(some.hint("merge"), ["leaf", "form"], "left")  # a row a form on either side
    fixed = F.size(F.filter(F.slice("t", 1, DEPTH), lambda x: x != "<*>"))
    need = (F.ceil(SIMILAR * F.size("t")) - fixed).cast("int")
    lines = met(held.withColumn("form", F.xxhash64("t")), kept, ["leaf", "form"], "rows", total)
    lines = lines.select("doc", "doc_id", "pos", "leaf", need.alias("need"), F.coalesce("kept", F.expr("array()")).alias("kept"))
    best = F.slice("kept", F.lit(1), F.greatest(F.lit(0), F.col("need")))
    return lines.where(F.size("kept") >= F.col("need")).select("doc", "doc_id", "pos", "leaf", F.xxhash64("leaf", best).alias("template"))


def _dropped(docs: DataFrame, min_docs: int, whole: bool, long: int) -> DataFrame:
    """(doc, doc_id, drop): the numbers of the lines that go, for each document that loses any."""
    lines = docs.select("doc", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    if whole:  # blank lines go before the line is split: a test of its tokens would be pushed down and split it again
        lines = _fields(lines.where(F.col("line").rlike(r"[^ \t\x0B\f\r]")), "doc", "doc_id", "pos", whole=True)
    else:
        lines = _fields(lines, "doc", "doc_id", "pos", whole=False).where(F.size("t") >= MIN_TOKENS)
    exact = [F.when(_long(F.col("line"), F.col("t"), long), F.xxhash64(_split(F.col("line")))).alias("exact")] if whole else []
    hashes = lines.select("doc", "doc_id", "pos", F.xxhash64("t").alias("form"), _leaf(F.col("t")).alias("leaf"), *exact)
    hashes = stash(hashes)
    total = hashes.count()
    leafed = stash(met(hashes, _recurring(hashes, ["leaf"], min_docs), ["leaf"], "rows", total).drop("first"))
    plain = met(leafed, _recurring(leafed, ["leaf", "form"], min_docs), ["leaf", "form"], "rows", total).where(_NOT_FIRST)

    wanted = leafed.groupBy("doc", "doc_id").agg(F.collect_set(F.struct("pos", "leaf")).alias("at"))
    wanted = wanted.withColumnRenamed("doc_id", "own")
    bound = F.array(F.struct(F.split("text", "\n").alias("lines"), F.col("at")))  # split once a row, not once a line of it
    read = F.get(F.transform(bound, lambda z: F.transform(z["at"], lambda a: F.struct(a["pos"].alias("pos"), a["leaf"].alias("leaf"), F.get(z["lines"], a["pos"]).alias("line")))), F.lit(0))
    held = docs.join(wanted.hint("merge"), "doc").where(F.col("doc_id").eqNullSafe(F.col("own"))).select("doc", "doc_id", F.explode(read).alias("at"))
    held = held.select("doc", "doc_id", "at.pos", "at.leaf", "at.line")
    held = stash(_fields(held, "doc", "doc_id", "pos", "leaf", whole=whole).drop("line"))
    forms = stash(held.groupBy("leaf", "t").agg(F.count("*").alias("n")))
    at = forms.select("leaf", "n", F.posexplode("t").alias("p", "token"))
    votes = at.groupBy("leaf", "p", "token").agg(F.sum("n").alias("n"), F.count("*").alias("forms"))
    size = forms.groupBy("leaf").agg(F.sum("n").alias("m"))
    general = (
        votes.groupBy("leaf", "p").agg(F.min(F.struct((-F.col("n")).alias("n"), "token")).alias("top"))
        .join(size, "leaf")
        .groupBy("leaf", "m")
        .agg(F.sort_array(F.collect_list(F.struct("p", F.when(-2 * F.col("top.n") >= F.col("m"), F.col("top.token")).otherwise("<*>").alias("token")))).alias("g"))
        .select("leaf", "m", F.col("g.token").alias("g"))
    )
    agree = F.aggregate(F.zip_with("t", "g", lambda a, b: (a.eqNullSafe(b) & (b != "<*>")).cast("int")), F.lit(0), lambda s, x: s + x)
    alike = met(held, general, ["leaf"], "m", total).where(agree >= SIMILAR * F.size("t")).select("doc", "doc_id", "pos", "leaf")
    alike = stash(alike)
    varied = met(alike, _recurring(alike, ["leaf"], min_docs), ["leaf"], "rows", total).where(_NOT_FIRST)
    at = ["doc", "doc_id", "pos"]
    gone = stash(plain.select(*at)).unionByName(stash(varied.select(*at)))  # one plan of all would hold every join's exchanges at once
    if whole:
        passages = hashes.where("exact is not null")
        passages = met(passages, _recurring(passages, ["leaf", "exact"], 2), ["leaf", "exact"], "rows", total).where(_NOT_FIRST)
        several = stash(_templates(held, forms, votes, min_docs, total))
        several = met(several, _recurring(several, ["leaf", "template"], min_docs), ["leaf", "template"], "rows", total).where(_NOT_FIRST)
        gone = gone.unionByName(stash(passages.select(*at))).unionByName(stash(several.select(*at)))
    gone = gone.distinct()
    return gone.groupBy("doc", "doc_id").agg(F.collect_list("pos").alias("drop"))


def _without(lines, drop):
    """lines joined without those at the places of drop: the runs between dropped places, so the work is linear in both."""
    edges = F.concat(F.array(F.lit(-1)), F.array_sort(drop), F.array(F.size(lines)))
    bound = F.array(F.struct(lines.alias("lines"), edges.alias("edges")))  # evaluated once a row, not once a run
    at = lambda z, k: F.get(z["edges"], k)
    runs = lambda z: F.transform(F.sequence(F.lit(0), F.size(z["edges"]) - 2), lambda k: F.slice(z["lines"], at(z, k) + 2, at(z, k + 1) - at(z, k) - 1))
    return F.get(F.transform(bound, lambda z: F.array_join(F.flatten(runs(z)), "\n")), F.lit(0))


def drop_recurring_lines(docs: DataFrame, min_docs: int = 10, whole: bool = False, long: int = LONG) -> DataFrame:
    """docs with text without its recurring lines, plus n_lines and n_dropped.

    docs needs doc_id and text; all other columns pass through (columns named n_lines or n_dropped are replaced).
    Lines are parted by \\n. Lines of fewer than MIN_TOKENS tokens always stay, unless whole; blank ones stay then too. A null text stays null and has 0
    lines, an empty one has 1. Rows with the same doc_id and text count as one document and get the same result; of
    rows with the same doc_id and other texts each is a document. A null doc_id never owns a template. A text that
    loses every line is empty. With whole, a line of `long` tokens goes from its second document on. Keys are hashes of
    64 bits for the leaf and 64 more within it.
    """
    docs = docs.drop("n_lines", "n_dropped")
    doc, own, drop = spare(docs, "doc", "own", "drop")
    keyed = docs.withColumn(doc, F.xxhash64("doc_id", "text"))
    rows = keyed.select(F.col(doc).alias("doc"), "doc_id", "text").where("text is not null")
    gone = stash(_dropped(rows, min_docs, whole, long).select(F.col("doc").alias(doc), F.col("doc_id").alias(own), F.col("drop").alias(drop)))
    lines = F.split("text", "\n")
    kept = _without(lines, F.col(drop))
    joined = keyed.join(gone.hint("merge"), [keyed[doc] == gone[doc], keyed["doc_id"].eqNullSafe(gone[own])], "left").drop(gone[doc])
    return joined.select(
        *[F.when(F.col(drop).isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(quoted(c)) for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)).alias("n_dropped"),
    )


def oracle(whole: bool, long: int = LONG) -> str:
    """SQL of drop_recurring_lines for min_docs = 10, with doc_id unique and not null."""
    share = f"{SIMILAR}::DOUBLE"
    bare = f"len(t) < {MIN_TOKENS} AND len(list_filter(t, lambda x: x <> '<*>')) = 0"
    fields = f"CASE WHEN {bare} THEN raw ELSE t END" if whole else "t"
    taken = "t[1] <> ''" if whole else f"len(t) >= {MIN_TOKENS}"
    more = _MORE.format(long=long, depth=DEPTH, share=share) if whole else ""
    also = " UNION SELECT * FROM passages UNION SELECT * FROM several" if whole else ""
    return _ORACLE.format(fields=fields, taken=taken, more=more, also=also, depth=DEPTH, share=share)


_ORACLE = r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
           FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, regexp_split_to_array(regexp_replace(line, '^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+$', '', 'g'), '[ \t\x0B\f\r]+') AS raw,
        regexp_split_to_array(regexp_replace(regexp_replace(line, '[^ \t\x0B\f\r]*[0-9][^ \t\x0B\f\r]*', '<*>', 'g'),
          '^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+$', '', 'g'), '[ \t\x0B\f\r]+') AS t FROM l),
m AS (SELECT doc_id, pos, line, raw, {fields} AS t FROM k),
h AS (SELECT *, {{'n': len(t), 'lead': t[1:{depth}]}} AS leaf FROM m WHERE {taken}),
rl AS (SELECT leaf FROM h GROUP BY leaf HAVING count(DISTINCT doc_id) >= 10),
held AS (SELECT h.* FROM h SEMI JOIN rl USING (leaf)),
rf AS (SELECT t, min(doc_id) AS first FROM held GROUP BY t HAVING count(DISTINCT doc_id) >= 10),
plain AS (SELECT doc_id, pos FROM held JOIN rf USING (t) WHERE doc_id <> first),
tok AS (SELECT leaf, unnest(t) AS token, generate_subscripts(t, 1) AS p FROM held),
votes AS (SELECT leaf, p, token, count(*) AS n FROM tok GROUP BY ALL),
top AS (SELECT leaf, p, token, n FROM votes QUALIFY row_number() OVER (PARTITION BY leaf, p ORDER BY n DESC, encode(token)) = 1),
sizes AS (SELECT leaf, count(*) AS m FROM held GROUP BY leaf),
gl AS (SELECT leaf, list(CASE WHEN 2 * n >= m THEN token ELSE '<*>' END ORDER BY p) AS g FROM top JOIN sizes USING (leaf) GROUP BY leaf),
alike AS (SELECT doc_id, pos, leaf FROM held JOIN gl USING (leaf)
          WHERE len(list_filter(list_zip(t, g), lambda z: z[1] = z[2] AND z[2] <> '<*>')) >= {share} * len(t)),
rg AS (SELECT leaf, min(doc_id) AS first FROM alike GROUP BY leaf HAVING count(DISTINCT doc_id) >= 10),
varied AS (SELECT doc_id, pos FROM alike JOIN rg USING (leaf) WHERE doc_id <> first),
{more}gone AS (SELECT * FROM plain UNION SELECT * FROM varied{also}),
out AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL) AS text, count(*) AS n_lines, count(gone.pos) AS n_dropped
        FROM l LEFT JOIN gone USING (doc_id, pos) GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_dropped, 0)::INT AS n_dropped,
       CASE WHEN d.text IS NULL THEN NULL ELSE length(coalesce(out.text, ''))::BIGINT END AS n_chars_kept,
       CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(out.text, '')) END AS text_md5
FROM documents d LEFT JOIN out USING (doc_id)
"""

#: What whole adds: long lines from the second document on, and several templates a leaf.
_MORE = r"""long AS (SELECT * FROM h WHERE len(t) >= {long} OR length(regexp_replace(line,
           '[^\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Thai}}\p{{Lao}}\p{{Khmer}}\p{{Myanmar}}\p{{Tibetan}}]+', '', 'g')) >= {long}),
rp AS (SELECT leaf, raw, min(doc_id) AS first FROM long GROUP BY leaf, raw HAVING count(DISTINCT doc_id) >= 2),
passages AS (SELECT doc_id, pos FROM long JOIN rp USING (leaf, raw) WHERE doc_id <> first),
places AS (SELECT leaf, t, unnest(t) AS token, generate_subscripts(t, 1) AS p FROM (SELECT DISTINCT leaf, t FROM held)),
kept AS (SELECT leaf, t, list({{'p': p, 'token': token}} ORDER BY n DESC, p) AS kept FROM places JOIN votes USING (leaf, p, token)
         WHERE p > {depth} AND token <> '<*>' AND n >= 10 GROUP BY leaf, t),
needs AS (SELECT doc_id, pos, leaf, coalesce(kept, []) AS kept,
            ceil({share} * len(t))::INT - len(list_filter(t[1:{depth}], lambda x: x <> '<*>')) AS need FROM held LEFT JOIN kept USING (leaf, t)),
found AS (SELECT doc_id, pos, leaf, list_slice(kept, 1, greatest(0, need)) AS template FROM needs WHERE len(kept) >= need),
rt AS (SELECT leaf, template, min(doc_id) AS first FROM found GROUP BY leaf, template HAVING count(DISTINCT doc_id) >= 10),
several AS (SELECT doc_id, pos FROM found JOIN rt USING (leaf, template) WHERE doc_id <> first),
"""
