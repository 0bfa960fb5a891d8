"""Line deduplication with a log-template tree, in DataFrame operations only.

A line is parsed down a tree of fixed depth: by its number of tokens, then by its `DEPTH` leading tokens,
tokens with a digit counting as variable fields. A leaf holds several templates, found in rounds. In a
round the leaf's open lines vote: a position is constant if one token holds `CONSTANT` of them there, and
a variable field otherwise. A line that agrees with enough of the constants takes the template; the others
stay open for the next round, as long as a round's template is taken by as many lines as a recurring one
needs. What is open in the end is a template of its own, its digit fields left out.

A template that recurs in `min_docs` documents or more is dropped everywhere but at its first place (the
least doc_id, then the least line). Lines of `LONG` tokens don't recur by chance: for them `LONG_DOCS`
documents are enough. But a document that consists of such rarely repeated lines by more than a part
`COPY` of its characters is taken for a copy, not for a text with a borrowed passage; it keeps them, for
near-duplicate removal to see it whole.

The corpus is scanned for leaves first. Only leaves with enough lines can hold a recurring template; a
bitmap says which hash buckets have one, and the second scan keeps the lines that fall into those. Lines
vote only in leaves that hold several different ones, each once, with its count, so that hot lines are
summed before anything is dealt out; of all others only hashes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convene.llm.common import cut, discard, near_buckets, spaced

MIN_DOCS, DEPTH, CONSTANT, SIMILAR, SIMILAR_REST = 8, 3, 0.5, 0.7, 0.5
LONG, LONG_DOCS, COPY = 50, 2, 0.25
FIELD = "<*>"
LETTER = r"\p{L}"

_MASK = "[^ ]*[0-9][^ ]*"


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), idx, line (white space as spaces, trimmed) of non-empty lines."""
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.posexplode(F.split(spaced(F.col("text")), "\n", -1)).alias("idx", "line"))
    return split.withColumn("line", F.trim("line")).where(F.col("line") != "")


def _masked(text: Column) -> Column:
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, _MASK, FIELD)).otherwise(text)


def _tokens() -> Column:
    return F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1


def _leaf(depth: int) -> Column:
    """Hash of a line's path in the tree: number of tokens, leading tokens with digit fields masked."""
    return F.xxhash64(_tokens(), _masked(F.substring_index("line", " ", depth)))


def _least(tokens: Column, min_docs: int) -> Column:
    """The documents that a template of so many tokens recurs in."""
    return F.when(tokens >= LONG, min(LONG_DOCS, min_docs)).otherwise(min_docs)


def _vote(open_: DataFrame, wanted: DataFrame, depth: int) -> DataFrame:
    """leaf, lh, k, n, says, tokens, template (null: the line does not fit) after one round of the leaves
    in `wanted`; lines of others, which a map of buckets let through, go."""
    counted = open_.select("leaf", "n", F.posexplode("tokens").alias("pos", "token")).groupBy("leaf", "pos", "token").agg(F.sum("n").alias("n"))
    top = counted.groupBy("leaf", "pos").agg(F.max(F.struct("n", "token")).alias("top"), F.sum("n").alias("n"))
    constant = F.when((F.col("top.n") >= CONSTANT * F.col("n")) & (F.col("top.token") != FIELD), F.col("top.token"))
    leaves = top.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("pos", constant.alias("token")))).alias("general"))
    # written first, so that a hot leaf's lines can be split in the join
    leaves = cut(leaves.join(wanted, "leaf", "left_semi").withColumn("general", F.col("general.token")), "lines-leaves")
    agreeing = F.zip_with("tokens", "general", lambda a, b: F.coalesce(a == b, F.lit(False)) | (a == FIELD))
    share = lambda flags: F.size(F.filter(flags, lambda x: x)) / F.greatest(F.size(flags), F.lit(1))
    rest = F.slice("agree", depth + 1, F.greatest(F.size("agree") - depth, F.lit(0)))
    general = F.array_join(F.transform("general", lambda t: F.coalesce(t, F.lit(FIELD))), " ")
    fits = (share(F.col("agree")) >= SIMILAR) & ((F.size("agree") <= depth) | (share(rest) >= SIMILAR_REST))
    voted = open_.join(leaves, "leaf").withColumn("agree", agreeing).select("leaf", "lh", "k", "n", "says", "tokens", F.when(fits, general).alias("template"))
    out = cut(voted, "lines-voted")
    discard(leaves)
    return out


def _parsed(hot: DataFrame, min_docs: int, depth: int) -> DataFrame:
    """leaf, lh, t (hash of the template), template (null: the line itself) of the different lines of
    `hot` in leaves with enough lines.

    A line that is a template of its own needs no text here: its own hash is its template's. So only
    lines of leaves with several different ones are dealt out, each once."""
    weight = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
    lines = cut(hot.groupBy("leaf", "lh").agg(F.max("k").alias("k"), F.count("*").alias("n"), F.max("says").alias("says")), "lines-counted")
    per = lines.groupBy("leaf").agg(F.sum("n").alias("all"), F.max("k").alias("k"), F.count("*").alias("lines"), F.min("lh").alias("lh"), F.max("says").alias("says"))
    per = cut(per.where(F.col("all") >= _least(F.col("k"), min_docs)).select("leaf", "lh", "says", (F.col("lines") > 1).alias("several")), "lines-per-leaf")
    itself = lambda open_: open_.where("says").select("leaf", "lh", F.col("lh").alias("t"), F.lit(None).cast("string").alias("template"))
    # a leaf's only line agrees with itself
    done = [itself(per.where(~F.col("several")))]
    on = per.where("several").select("leaf")
    # a map of buckets lets few other texts through, and their hashes stop those
    texts = near_buckets(hot, F.col("leaf"), on).groupBy("leaf", "lh").agg(F.first("line").alias("line"))
    open_ = lines.join(on, "leaf", "left_semi").join(texts, ["leaf", "lh"])
    open_ = cut(open_.select("leaf", "lh", "k", "n", "says", F.split("line", " ", -1).alias("tokens")), "lines-open")
    used = [lines, per, open_]
    while not on.isEmpty():
        voted = _vote(open_, on, depth)
        fitted = F.col("template").isNotNull()
        per = voted.groupBy("leaf").agg(weight(fitted).alias("fitted"), weight(~fitted).alias("rest"), F.max("k").alias("k"))
        on = cut(per.where((F.col("fitted") >= _least(F.col("k"), min_docs)) & (F.col("rest") > 0)).select("leaf"), "lines-on")
        # a template of fields and signs alone says nothing
        done.append(voted.where(F.col("template").rlike(LETTER)).select("leaf", "lh", F.xxhash64("template").alias("t"), "template"))
        done.append(itself(voted.where(~fitted).select("leaf", "lh", "says").join(on, "leaf", "left_anti")))
        open_ = cut(near_buckets(voted.where(~fitted).drop("template"), F.col("leaf"), on), "lines-open")
        used += [voted, on, open_]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = cut(out, "lines-parsed")
    discard(*used)
    return out


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, texts: bool = True) -> DataFrame:
    """doc_id, th, idx, len (characters), rare (held by fewer than `min_docs` documents) and, if `texts`,
    template of every line that recurs, but for first places."""
    lines = _lines(docs).withColumn("leaf", _leaf(depth))
    enough = lines.groupBy("leaf").agg(F.count("*").alias("n"), F.max(_tokens()).alias("k"))
    frequent = cut(enough.where(F.col("n") >= _least(F.col("k"), min_docs)).select("leaf"), "lines-frequent")
    held = near_buckets(lines, F.col("leaf"), frequent)
    hot = held.select("doc_id", "th", "idx", "leaf", F.length("line").alias("len"), _tokens().alias("k"), _masked(F.col("line")).alias("line"))
    hot = cut(hot.withColumn("lh", F.xxhash64("line")).withColumn("says", F.col("line").rlike(LETTER)), "lines-hot")
    parsed = _parsed(hot, min_docs, depth)
    # templates can be as long as lines: where lines meet them, their hashes do
    named = parsed.select("leaf", "lh", "t")
    placed = cut(hot.drop("line", "says").join(named, ["leaf", "lh"]).select("doc_id", "th", "idx", "leaf", "k", "len", "t"), "lines-placed")
    first = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id"), F.col("th"), F.col("idx"))
    per_doc = placed.groupBy("leaf", "t", "doc_id", "th").agg(F.min("idx").alias("idx"), F.max("k").alias("k"))
    kept = per_doc.groupBy("leaf", "t").agg(F.count("*").alias("docs"), F.max("k").alias("k"), F.min(first).alias("first"))
    # written first, so that the other side's hot templates can be split in the join
    kept = cut(kept.where(F.col("docs") >= _least(F.col("k"), min_docs)).drop("k"), "lines-kept")
    found = placed.join(kept, ["leaf", "t"]).withColumn("rare", F.col("docs") < min_docs)
    found = found.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")) & (F.col("idx") == F.col("first.idx"))))
    if texts:
        said = parsed.where(F.col("template").isNotNull()).select("leaf", "t", "template").unionByName(hot.select("leaf", F.col("lh").alias("t"), F.col("line").alias("template")))
        found = found.join(said.groupBy("leaf", "t").agg(F.first("template").alias("template")), ["leaf", "t"])
    out = cut(found.select("doc_id", "th", "idx", "len", "rare", *(["template"] if texts else [])), "lines-recurring")
    discard(frequent, hot, parsed, placed, kept)
    return out


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH) -> DataFrame:
    """docs (doc_id, text, ...) with recurring lines taken out of text, and n_lines and n_dropped added.

    A null text stays null, with 0 lines; an empty one is one line, which is never dropped, nor are blank
    lines. Rows that share doc_id and text are one document and lose the same lines. Of equal templates
    the one with the least doc_id, text hash and line stays; a null doc_id comes last. Texts of any number
    of lines are rebuilt in linear time. A document of which nothing but blank lines is left keeps its
    row; the caller may drop it. Columns named n_lines or n_dropped are replaced; all others stay as they
    are, whatever their names; an empty table gives no row."""
    lost = recurring(docs, min_docs, depth, False)
    # what one document loses: the rare lines only if they are no more than a part of it
    gone = lost.groupBy("doc_id", "th").agg(F.collect_set("idx").alias("every"), F.collect_set(F.when(~F.col("rare"), F.col("idx"))).alias("common"), F.coalesce(F.sum(F.when(F.col("rare"), F.col("len"))), F.lit(0)).alias("rare_len"))
    gone = gone.select(F.struct("*").alias("gone"))
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*keep).alias("row"))
    text, th = F.col("row.text"), F.xxhash64("row.text")
    joined = rows.join(gone, F.col("row.doc_id").cast("long").eqNullSafe(F.col("gone.doc_id")) & (th == F.col("gone.th")), "left")
    idx = F.when(F.col("gone.rare_len") <= COPY * F.length(text), F.col("gone.every")).otherwise(F.col("gone.common"))
    joined = joined.select("row", idx.alias("idx"))
    # the split text is bound to a variable once: the lines that stay are looked up by number
    left = F.expr(r"element_at(transform(array(split(row.text, '\n', -1)), ls -> array_join(transform(array_except(sequence(0, size(ls) - 1), idx), i -> element_at(ls, i + 1)), '\n')), 1)")
    n_lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    return joined.select(
        *(F.when(F.coalesce(F.size("idx"), F.lit(0)) <= 0, text).otherwise(left).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in keep),
        n_lines.cast("long").alias("n_lines"),
        F.greatest(F.coalesce(F.size("idx"), F.lit(0)), F.lit(0)).cast("long").alias("n_dropped"),
    )


#: DuckDB SQL for doc_id, text, n_lines, n_dropped of drop_lines() over documents.
SQL = f"""
    WITH RECURSIVE docs AS (SELECT doc_id, text FROM documents GROUP BY doc_id, text),
    raw AS (
        SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx, unnest(string_split(text, chr(10))) AS line
        FROM docs WHERE text IS NOT NULL
    ), lines AS (
        SELECT doc_id, text, idx, trim(translate(line, chr(9) || chr(13) || chr(11) || chr(12), '    '), ' ') AS line FROM raw
    ), masked AS (
        SELECT doc_id, text, idx, len(line) AS chars, regexp_replace(line, '{_MASK}', '{FIELD}', 'g') AS line FROM lines WHERE line <> ''
    ), parsed AS (
        SELECT *, string_split(line, ' ') AS tokens FROM masked
    ), leafed AS (
        SELECT *, len(tokens) AS k, array_to_string(tokens[1:{DEPTH}], ' ') AS lead FROM parsed
    ), voted(k, lead, line, tokens, n, template) AS (
        SELECT k, lead, line, tokens, count(*) AS n, NULL::VARCHAR FROM leafed GROUP BY ALL
        UNION ALL
        SELECT k, lead, line, tokens, n, CASE
            WHEN fits THEN array_to_string(list_transform(general, lambda t: coalesce(t, '{FIELD}')), ' ')
            WHEN sum(CASE WHEN fits THEN n ELSE 0 END) OVER (PARTITION BY k, lead) < (CASE WHEN k >= {LONG} THEN {LONG_DOCS} ELSE {MIN_DOCS} END) THEN line END
        FROM (
            SELECT *, list_sum(agree) >= {SIMILAR} * k AND (k <= {DEPTH} OR list_sum(agree[{DEPTH + 1}:]) >= {SIMILAR_REST} * (k - {DEPTH})) AS fits
            FROM (
                SELECT d.k, d.lead, d.line, d.tokens, d.n, l.general,
                    list_transform(range(1, d.k + 1), lambda i: CASE WHEN coalesce(d.tokens[i] = l.general[i], false) OR d.tokens[i] = '{FIELD}' THEN 1 ELSE 0 END) AS agree
                FROM voted d JOIN (
                    SELECT k, lead, list(CASE WHEN top.n >= {CONSTANT} * n AND top.token <> '{FIELD}' THEN top.token END ORDER BY pos) AS general
                    FROM (
                        SELECT k, lead, pos, max(struct_pack(n := n, token := token)) AS top, sum(n) AS n
                        FROM (
                            SELECT k, lead, pos, token, sum(n) AS n
                            FROM (SELECT k, lead, n, generate_subscripts(tokens, 1) AS pos, unnest(tokens) AS token FROM voted WHERE template IS NULL)
                            GROUP BY k, lead, pos, token
                        ) GROUP BY k, lead, pos
                    ) GROUP BY k, lead
                ) l ON d.k = l.k AND d.lead = l.lead
                WHERE d.template IS NULL
            )
        )
    ), placed AS (
        SELECT l.doc_id, l.text, l.idx, l.chars, l.k, l.lead, c.template FROM leafed l JOIN (SELECT * FROM voted WHERE template IS NOT NULL) c USING (k, lead, line)
        WHERE regexp_matches(replace(c.template, '{FIELD}', ''), '\\p{{L}}')
    ), kept AS (
        SELECT k, lead, template, count(DISTINCT struct_pack(d := doc_id, t := text)) AS n_docs, min(struct_pack(a := doc_id IS NULL, d := doc_id, t := text, i := idx)) AS first
        FROM placed GROUP BY k, lead, template HAVING n_docs >= CASE WHEN k >= {LONG} THEN {LONG_DOCS} ELSE {MIN_DOCS} END
    ), lost AS (
        SELECT p.doc_id, p.text, p.idx, p.chars, n_docs < {MIN_DOCS} AS rare FROM placed p JOIN kept USING (k, lead, template)
        WHERE NOT (p.doc_id IS NOT DISTINCT FROM first.d AND p.text = first.t AND p.idx = first.i)
    ), gone AS (
        SELECT doc_id, text, list(idx) AS gone FROM lost
        WHERE NOT rare OR (SELECT sum(r.chars) FROM lost r WHERE r.rare AND r.doc_id IS NOT DISTINCT FROM lost.doc_id AND r.text = lost.text) <= {COPY} * len(text)
        GROUP BY doc_id, text
    ), rebuilt AS (
        SELECT r.doc_id, r.text, coalesce(string_agg(r.line, chr(10) ORDER BY r.idx) FILTER (NOT list_contains(g.gone, r.idx)), '') AS rest, any_value(len(g.gone)) AS n
        FROM raw r JOIN gone g ON r.doc_id IS NOT DISTINCT FROM g.doc_id AND r.text = g.text GROUP BY r.doc_id, r.text
    )
    SELECT d.doc_id, CASE WHEN b.n IS NULL THEN d.text ELSE b.rest END AS text,
        CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(d.text) - len(replace(d.text, chr(10), '')) + 1 END AS BIGINT) AS n_lines,
        CAST(coalesce(b.n, 0) AS BIGINT) AS n_dropped
    FROM documents d LEFT JOIN rebuilt b ON d.doc_id IS NOT DISTINCT FROM b.doc_id AND d.text = b.text
"""
