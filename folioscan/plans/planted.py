"""A planted corpus over the documents table, and what each planted line is known to show.

The tables' text holds none of the phrases that the rules look for, so every
document gets six blocks after its own text, picked by arithmetic on its id. What
a planted line shows was written down by hand next to it; oracles join on the
line's text and never read a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Hits = list[tuple[str, str, str]]
R, G = "revision", "generation"

#: Single lines: text, what the revision pack finds, what the generation pack finds.
SINGLE: list[tuple[str, Hits, Hits]] = [
    # prior state, its suppressor, and what the suppressor doesn't reach
    ("The retry limit was previously five.", [("0a", "prior-state reference", "previously")], []),
    ("It is no longer read at start.", [("0a", "prior-state reference", "no longer")], []),
    ("Nordwind, formerly Seeblick, is a company in Kiel.", [], []),
    ("The loader used to parse dates twice.", [("0a", "past-habitual 'used to'", "used to parse")], []),
    ("A key (used to sign tokens) is rotated weekly.", [], []),
    ("The name of the salt used to mix them is fixed.", [], []),
    ("The corrected formula is in use.", [("0a", "self-correction", "The corrected formula")], []),
    ("The second pass found two leaks.", [("0a", "pass/round marker", "second pass")], []),
    ("Round two of the survey closed in May.", [], []),
    ("Added in 2.4 with the new parser.", [("0b", "version changelog", "Added in 2.4")], []),
    ("The worker now merges small files.", [("0b", "recency marker on behaviour", "now merges")], []),
    ("Leave it as it is for now unless asked.", [], []),
    ("The flag has been removed.", [("0b", "perfect-tense changelog", "has been removed")], []),
    ("Once the index has been updated, queries read it.", [], []),
    ("The path was recently changed by hand.", [("0b", "recency marker", "was recently")], []),
    ("The most recent was recently listed.", [], []),
    ("Errors were silent until recently.", [("0b", "pre-change narrative", "until recently")], []),
    ("Status: 2024-03-01", [("0c", "dated status stamp", "Status: 2024-03-01")], []),
    ("The queue is currently in memory.", [("0c", "implicit 'as of now'", "currently")], []),
    ("See ticket #41, which is blocked by legal.", [("0d", "status claim on a tracker item", "ticket #41, which is blocked")], []),
    ("Streaming is not yet supported.", [("0d", "future promise", "not yet supported")], []),
    ("One limitation is the cache size.", [("0.5", "explicit caveat", "limitation")], []),
    ("However, the cache is shared.", [("0.5", "mid-sentence concession", "However")], []),
    ("There is a hazard in the lock order.", [("0.5", "risk note", "hazard")], []),
    ("| key | " + "padding " * 26 + "| caveat |", [], []),
    ("| key | caveat |", [("0.5", "explicit caveat", "caveat")], []),
    ("This page lists every flag.", [("1", "document self-reference", "This page")], []),
    ("The table below has the codes.", [("2", "navigation", "The table below")], []),
    ("Please read the manual first.", [("2", "navigation", "read the manual first")], []),
    ("A mortgage read as first-year spending.", [], []),
    ("Three caveats apply to this rule:", [("0.5", "explicit caveat", "caveat"), ("4", "enumerative pre-announcement", "Three caveats apply to this rule:")], []),
    ("There are Four reasons for it.", [("4", "inline count preamble", "Four reasons")], []),
    ("It is worth noting that disks fill up.", [("5", "'worth X' attitude marker", "worth noting")], []),
    ("Her net worth the bank knows.", [], []),
    ("The key takeaway is the order.", [("6", "salience superlative", "The key takeaway")], []),
    ("The most fragile step is the merge.", [("6", "salience superlative", "The most fragile")], []),
    ("Notably, the merge is stable.", [("6", "salience adverb", "Notably")], []),
    ("The split is done on purpose.", [("7", "intent disclosure", "on purpose")], []),
    ("It is not a cache; it is a log.", [("8", "contrastive framing", "not a cache; it is")], []),
    ("The diff is the record, they say.", [("9", "meta-commentary on the record", "The diff is the record")], []),
    ("# Why the cache is small", [("10", "heading argues rather than names", "# Why")], []),
    ("## Latency matters", [("10", "heading argues rather than names", "matters")], []),
    ("The `previously` flag is **formerly** of `x_y`.", [("0a", "prior-state reference", "formerly")], []),
    ("The host has been moved again. After a key has been added, it starts.", [("0b", "perfect-tense changelog", "has been moved")], []),
    # tutorials walk their reader
    ("Moving on, the next part is storage.", [("3", "walking the reader", "Moving on")], []),
    ("Let's say the list is empty.", [], []),
    # generation residue
    ("I've added the parser.", [], [("0a", "assistant self-narration", "I've added")]),
    ("As an AI assistant I lack access.", [], [("0a", "model disclaimer", "As an AI assistant")]),
    ("Hope this helps!", [], [("0a", "chat pleasantry", "Hope this helps")]),
    ("Summary of changes in the module.", [], [("0b", "handoff summary", "Summary of changes")]),
    ("All 12 tests now pass.", [("0b", "recency marker on behaviour", "now pass")], [("0b", "test-pass assertion", "All 12 tests now pass")]),
    ("Make sure all tests pass on main.", [], []),
    ("Contact [Your team name] by mail.", [], [("0c", "unfilled placeholder", "[Your team name]")]),
    ("A link [Add one](x/missing.md) is no gap.", [], [("0d", "phantom relative link", "x/missing.md")]),
    ("A robust queue feeds it.", [], [("1", "importance inflation", "robust")]),
    ("They report robust standard errors.", [], []),
    ("The tool can leverage caches.", [], [("2", "lexical tell", "leverage")]),
    ("The test harness is in place.", [], []),
    ("Logs play a key role here.", [], [("2", "role inflation", "play a key role")]),
    ("Whether you're a novice or not.", [], [("3", "essay scaffold", "Whether you're a")]),
    ("In conclusion, the cache helps.", [], [("3", "essay scaffold", "In conclusion")]),
    ("It isn't just fast.", [], [("4", "symmetric filler", "isn't just fast")]),
    ("## Key Takeaways", [], [("3", "narrative heading", "## Key Takeaways")]),
    ("## \U0001f680 Setup", [], [("5", "emoji decoration", "\U0001f680")]),
    ("- ✨ quick to start", [], [("5", "emoji decoration", "✨")]),
    ("| ✅ | yes |", [], []),
    ("Press the ⌘ key ✨ now.", [], []),
    # links
    ("See [the guide](../src0/nothere.md#top) here.", [], [("0d", "phantom relative link", "../src0/nothere.md#top")]),
    ("An [anchor](#top), a [site](https://a.example/x) and a [root](/abs.md).", [], []),
    ("Up one is [the folder](../src3) here.", [], []),
    # rewrites
    ("## \u2728 Fast  path \u2b50", [], [("5", "emoji decoration", "\u2728")]),
    ("In summary, the log helps.", [], [("3", "essay scaffold", "In summary")]),
    ("Thanks for reading! Happy coding.", [], [("0a", "chat pleasantry", "Thanks for reading")]),
    ("Five ports worth opening early:", [("4", "enumerative pre-announcement", "Five ports worth opening early:")], []),
    ("It runs cold. Please note that the API is slow.", [("0.5", "mid-sentence concession", "note that")], []),
    ("Then confirmed against the log.", [], []),
    ("Plain line with nothing to say.", [], []),
]

#: Blocks of several lines: lines, then (first line, second line, pack, class, label, match) across a line's end.
MULTI: list[tuple[list[str], list[tuple[int, str, str, str, str]]]] = [
    (["The backoff step is the", "least stable of them all."], [(0, R, "6", "salience superlative", "the least stable")]),
    (["It is not only a queue", "but also a log."], [(0, G, "4", "symmetric filler", "not only a queue but also")]),
    (["The cache is no", "- longer a list item"], []),
    (["The index, which is no", "longer kept, was dropped."], [(0, R, "0a", "prior-state reference", "no longer")]),
    (["```text", "The limit was previously nine inside a fence.", "```"], []),
    (["~~~", "A robust fence with no longer.", "```"], []),
    (["<!-- hidden: it was previously so", "and a robust claim here", "until the end -->"], []),
    (["<!-- one line: currently hidden -->"], []),
    (["---", "", "***", "", "___", "", "Some words after the rules."], []),
    (["- **Alpha**: one", "- **Beta**: two", "- **Gamma**: three", "1. **Delta**: four", "* **Omega**: five"], []),
    (["- **Solo**: one", "- **Duo**: two"], []),
    (["## Empty part", "", "## Full part", "Body of the part."], []),
    (["### Holder", "", "#### Inner", "Text inside."], []),
    (["Repeated across every file: the gateway drops stale sessions after nine minutes.", "Other words."], []),
]

#: Relative links that SINGLE's lines hold: line, target, steps up, rest of the path.
LINKS: list[tuple[str, str, int, str]] = [
    ("A link [Add one](x/missing.md) is no gap.", "x/missing.md", 0, "x/missing.md"),
    ("See [the guide](../src0/nothere.md#top) here.", "../src0/nothere.md#top", 1, "src0/nothere.md"),
    ("Up one is [the folder](../src3) here.", "../src3", 1, "src3"),
]
#: Hits that a suppressor drops wherever they stand: pack, line, label, match.
SUPPRESSED: list[tuple[str, str, str, str]] = [
    (R, "Nordwind, formerly Seeblick, is a company in Kiel.", "prior-state reference", "formerly"),
    (R, "A key (used to sign tokens) is rotated weekly.", "past-habitual 'used to'", "used to sign"),
    (R, "The name of the salt used to mix them is fixed.", "past-habitual 'used to'", "used to mix"),
    (R, "Round two of the survey closed in May.", "pass/round marker", "Round two"),
    (R, "Once the index has been updated, queries read it.", "perfect-tense changelog", "has been updated"),
    (R, "The most recent was recently listed.", "recency marker", "was recently"),
    (G, "They report robust standard errors.", "importance inflation", "robust"),
    (G, "The test harness is in place.", "lexical tell", "harness"),
    (G, "Make sure all tests pass on main.", "test-pass assertion", "all tests pass"),
]
SUPPRESSIBLE = {
    R: ["prior-state reference", "past-habitual 'used to'", "pass/round marker", "perfect-tense changelog", "recency marker", "walking the reader"],
    G: ["importance inflation", "lexical tell", "test-pass assertion", "essay scaffold"],
}
GUIDE_LABELS = ["walking the reader", "essay scaffold"]
#: What a rewrite makes of a line: pack, line, new line (None deletes it), what it says.
EDITED: list[tuple[str, str, str | None, str]] = [
    (R, "It is worth noting that disks fill up.", "Disks fill up.", "removed 'it is worth … that'"),
    (R, "Five ports worth opening early:", "Five ports:", "dropped the 'worth …' wrapper of a list's opening"),
    (R, "It runs cold. Please note that the API is slow.", "It runs cold. The API is slow.", "removed 'please note that'"),
    (R, "Then confirmed against the log.", "Confirmed against the log.", "removed 'Then' before 'confirmed'"),
    (G, "In conclusion, the cache helps.", "The cache helps.", "removed 'In conclusion,'"),
    (G, "In summary, the log helps.", "The log helps.", "removed 'In summary,'"),
    (G, "Hope this helps!", None, "deleted a line of pleasantries"),
    (G, "Thanks for reading! Happy coding.", None, "deleted a line of pleasantries"),
    (G, "## \U0001f680 Setup", "## Setup", "stripped emoji from a heading"),
    (G, "## \u2728 Fast  path \u2b50", "## Fast path", "stripped emoji from a heading"),
]

#: Lines of source files; what each comment shows.
CODE: list[tuple[str, str | None, Hits, Hits]] = [
    ("x = 1  # the limit was previously seven", "the limit was previously seven", [("0a", "prior-state reference", "previously")], []),
    ("# TODO: this is not yet supported", None, [], []),
    ("# noqa: currently ignored", None, [], []),
    ('tag = "#formerly"', None, [], []),
    ("#", None, [], []),
    ("## the worker now drops rows", "the worker now drops rows", [("0b", "recency marker on behaviour", "now drops")], []),
    ("y = 2  # a robust default", "a robust default", [], [("1", "importance inflation", "robust")]),
]
_JS = [
    "/* the flag has been renamed",
    " * currently unused",
    " */ let a = 1;",
    "let b = 2; // a seamless join",
    'let u = "http://formerly.example";',
]
#: Line of the block, its comment text, and what it shows.
JS: list[tuple[str, str | None, Hits, Hits]] = [
    (_JS[0], "the flag has been renamed", [("0b", "perfect-tense changelog", "has been renamed")], []),
    (_JS[1], "currently unused", [("0c", "implicit 'as of now'", "currently")], []),
    (_JS[2], None, [], []),
    (_JS[3], "a seamless join", [], [("1", "importance inflation", "seamless")]),
    (_JS[4], None, [], []),
]

BLOCKS: list[str] = [s for s, *_ in SINGLE] + ["\n".join(lines) for lines, _ in MULTI]
SLOTS, STRIDE, STEP = 6, 5, 17
FRONT = "---\ntitle: previously a draft\n---\n"
#: Files without a finding have this in place of blocks; some files end in lines with breaks of every kind.
CALM = "Plain line with nothing to say.\n"
ODD = "Form\x0cfeed.\x0bTab\u2028Sep\x85End\x1cFour\u2029Five\r\nReturn\rLast\n"
#: Files with near-identical paragraphs of short sentences, so that no sentence repeats: id, text.
_short = "Cold brine flows past the old gate. Grey sand fills the low north dock. Thin rope holds the last blue skiff. Warm salt dries upon each flat stone. Soft rain ends before the noon bell."
ECHOES: list[tuple[int, str]] = [
    (900_000_000_001, "Some words first.\n\n" + _short),
    (900_000_000_002, _short.replace("blue", "green")),
    (900_000_000_003, "- an item\n" + _short.replace("noon", "dusk") + "\n\n" + _short.replace("Thin", "Damp")),
    (900_000_000_004, _short + "\n\nThis one sentence of eight words stands in two files."),
    (900_000_000_005, _short + " This one sentence of eight words stands in two files."),
]
CODE_TEXT, JS_TEXT = "\n".join(c for c, *_ in CODE), "\n".join(_JS)


def own_id() -> Column:
    """doc_id, or a number made from the text of a document without one."""
    return F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64("text"), 8))


def path_column() -> Column:
    i, at = F.col("id").cast("string"), F.pmod("id", F.lit(20))
    base = F.concat_ws("/", F.lit("docs"), "lang", "source")
    name = F.concat(i, F.lit(".md"))
    return (
        F.when(at == 1, F.concat(base, F.lit("/adr/"), name))
        .when(at == 2, F.concat(base, F.lit("/quickstart-"), name))
        .when(at == 3, F.concat(base, F.lit("/"), i, F.lit(".py")))
        .when(at == 4, F.concat(base, F.lit("/2024-05-06-"), name))
        .when(at == 5, F.concat(base, F.lit("/"), i, F.lit(".js")))
        .when(at == 6, F.concat(base, F.lit("/changelog-"), name))
        .when(at == 7, F.concat(base, F.lit("/history"), i, F.lit(".markdown")))
        .otherwise(F.concat(base, F.lit("/"), name))
    )


def planted(documents: DataFrame) -> DataFrame:
    """file_ord, path, content, a file for each document."""
    documents = documents.withColumn("id", own_id())
    at = F.pmod("id", F.lit(20))
    blocks = F.array(*[F.lit(b) for b in BLOCKS])
    picked = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.element_at(blocks, (F.pmod(F.col("id") * STRIDE + i * STEP, F.lit(len(BLOCKS))) + 1).cast("int")))
    text = F.coalesce(F.col("text"), F.lit(""))
    md = F.concat(F.when(F.pmod("id", F.lit(4)) == 0, FRONT).otherwise(""), text, F.lit("\n\n"), F.array_join(picked, "\n\n"), F.lit("\n"))
    comment = F.concat(F.lit("# "), F.regexp_replace(text, "\n", "\n# "), F.lit("\n"))
    content = (
        F.when(at == 3, F.concat(comment, F.lit(CODE_TEXT)))
        .when(at == 5, F.concat(F.lit(JS_TEXT + "\n// "), F.regexp_replace(text, "\n", "\n// ")))
        .when(at == 8, F.concat(text, F.lit("\n\n" + CALM)))
        .when(at == 9, F.concat(md, F.lit(ODD)))
        .otherwise(md)
    )
    return documents.select(F.col("id").alias("file_ord"), path_column().alias("path"), content.alias("content"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def plain_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as they are, a markdown file each, and ECHOES."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(own_id().alias("file_ord"), F.coalesce("text", F.lit("")).alias("content"))
    every = docs.unionByName(spark.createDataFrame(ECHOES, "file_ord long, content string"))
    return every.select("file_ord", F.concat(F.col("file_ord").cast("string"), F.lit(".md")).alias("path"), "content")


# ------------------------------------------------------------------- DuckDB


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def corpus_sql() -> str:
    """The same corpus in DuckDB: common table expressions corpus(file_ord, path, content) and lines."""
    blocks = ", ".join(quote(b) for b in BLOCKS)
    return f"""
    blocks as (select [{blocks}] as b),
    corpus as (
        select doc_id as file_ord,
            'docs/' || lang || '/' || source || case doc_id % 20
                when 1 then '/adr/' || doc_id || '.md' when 2 then '/quickstart-' || doc_id || '.md' when 3 then '/' || doc_id || '.py'
                when 4 then '/2024-05-06-' || doc_id || '.md' when 5 then '/' || doc_id || '.js' when 6 then '/changelog-' || doc_id || '.md'
                when 7 then '/history' || doc_id || '.markdown' else '/' || doc_id || '.md' end as path,
            case doc_id % 20
                when 3 then '# ' || replace(text, chr(10), chr(10) || '# ') || chr(10) || {quote(CODE_TEXT)}
                when 5 then {quote(JS_TEXT)} || chr(10) || '// ' || replace(text, chr(10), chr(10) || '// ')
                when 8 then text || chr(10) || chr(10) || {quote(CALM)}
                else case when doc_id % 4 = 0 then {quote(FRONT)} else '' end || text || chr(10) || chr(10)
                    || array_to_string(list_transform(range(0, {SLOTS}), lambda i: b[1 + (doc_id * {STRIDE} + i * {STEP}) % {len(BLOCKS)}]), chr(10) || chr(10)) || chr(10) || case when doc_id % 20 = 9 then {quote(ODD)} else '' end end as content
        from documents, blocks),
    split as (select file_ord, path, string_split_regex(content, {quote(_BREAKS)}) as s, regexp_extract_all(content, {quote(_BREAKS)}) as b from corpus),
    parts as (select file_ord, path, case when s[len(s)] = '' then s[1 : len(s) - 1] else s end as s, b from split),
    lines as (select file_ord, path, unnest(s) as raw, unnest(range(1, len(s) + 1)) as line_no, unnest(b[1 : len(s)]) as brk from parts)"""
