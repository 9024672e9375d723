"""Independent DuckDB SQL for each query.

What lines show comes from the hand-written tables of planted.py, by equality of
whole lines; states and shapes are worked out again with SQL windows. No rule's
regular expression is used here.
"""

from __future__ import annotations

from . import planted as P
from .queries import CLASS_QUERIES
from .rules import REVISION

q = P.quote


def values(rows: list[tuple]) -> str:
    one = lambda v: "cast(null as varchar)" if v is None else str(v).lower() if isinstance(v, (bool, int)) else q(v)
    return "(values " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows) + ")"


MD = "path not like '%.py' and path not like '%.js'"
STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
CORPUS = P.corpus_sql()


def _expected(pack: str) -> str:
    """found_<pack>(path, file_ord, line, class, label, match, text, pass, nth): the line and wrap passes."""
    at = 1 if pack == P.R else 2
    md = [(x[0], *h, i) for x in P.SINGLE for i, h in enumerate(x[at])]
    code = [(x[0], x[1], *h) for x in P.CODE + P.JS for h in x[at + 1]]
    wrap = [(ls[i], ls[i + 1], c, label, m) for ls, hits in P.MULTI for i, p, c, label, m in hits if p == pack]
    guide = ", ".join(q(x) for x in P.GUIDE_LABELS)
    return f"""
    md_{pack}(raw, class, label, match, nth) as (select * from {values(md)}),
    code_{pack}(raw, comment, class, label, match) as (select * from {values(code)}),
    wrap_{pack}(a, b, class, label, match) as (select * from {values(wrap)}),
    found_{pack} as (
        select path, file_ord, line_no as line, class, label, match, trim(raw) as text, 0 as pass, nth from lines join md_{pack} using (raw)
            where {MD} and label not like 'phantom%' and not (label in ({guide}) and path like '%quickstart%')
        union all select path, file_ord, line_no, class, label, match, comment, 0, 0 from lines join code_{pack} using (raw) where not ({MD})
        union all select x.path, x.file_ord, x.line_no, class, label, match, trim(x.raw) || ' ' || trim(y.raw), 2, 0
            from lines x join lines y on x.file_ord = y.file_ord and y.line_no = x.line_no + 1 join wrap_{pack} w on w.a = x.raw and w.b = y.raw where {MD.replace("path", "x.path")})"""


STATES = f"""
    md_lines as (select *, {STRIP.format("raw")} as s from lines where {MD}),
    fm as (select file_ord, case when max(case when line_no = 1 and s = '---' then 1 end) = 1
        then coalesce(min(case when line_no between 2 and 60 and s in ('---', '...') then line_no end), 0) else 0 end as fm_end from md_lines group by file_ord),
    fenced as (
        select *, f and true as is_fence, not f and sum(f::int) over (partition by file_ord order by line_no) % 2 = 1 as in_fence
        from (select l.*, fm_end, line_no > fm_end and (s like '```%' or s like '~~~%') as f from md_lines l join fm using (file_ord))),
    shown as (select *, case when s like '<!--%' and not contains(s, '-->') then 1 when contains(s, '-->') then 0 end as ev
        from fenced where line_no > fm_end and not is_fence and not in_fence),
    commented as (select *, coalesce(last_value(ev ignore nulls) over (partition by file_ord order by line_no rows between unbounded preceding and 1 preceding), 0) = 1 as in_comment from shown),
    prose as (select * from commented where not in_comment and s not like '<!--%' and s <> '')"""

_unmarked = "regexp_replace(regexp_replace(regexp_replace(raw, '`[^`]+`', '`code`', 'g'), '([^\\s*])[*]{1,3}', '\\1', 'g'), '[*_]{1,3}([^\\s*_])', '\\1', 'g')"
PLAIN = f"case when raw in ('***', '___') then '' else regexp_replace({_unmarked}, '([^\\s_])_{{1,3}}', '\\1', 'g') end"
BLOCK = "regexp_matches(raw, '^\\s*(#{1,6}\\s|\\||[-*+]\\s|[0-9]+[.)]\\s|>)')"


def _paras(lines: str) -> str:
    """paras(path, file_ord, start_line, text) over a table of prose lines."""
    return f"""
    marked as (select *, {BLOCK} as block, {STRIP.format(PLAIN)} as piece from {lines}),
    broken as (select *, case when block or lag(block) over w or lag(line_no) over w is distinct from line_no - 1 then 1 else 0 end as opens
        from marked window w as (partition by file_ord order by line_no)),
    isles as (select *, sum(opens) over (partition by file_ord order by line_no) as isle from broken),
    paras as (select path, file_ord, min(line_no) as start_line, string_agg(piece, ' ' order by line_no) as text from isles where not block group by path, file_ord, isle)"""


RAW = f"""
    plain_files(file_ord, content) as (select doc_id, text from documents union all select * from {values(P.ECHOES)}),
    raw_lines as (select file_ord, file_ord || '.md' as path, unnest(string_split(content, chr(10))) as raw, generate_subscripts(string_split(content, chr(10)), 1) as line_no from plain_files),
    raw_prose as (select * from raw_lines where {STRIP.format("raw")} <> ''),{_paras("raw_prose")}"""
NORM = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"
SENTENCES = f"""
    pieces as (select path, file_ord, start_line, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) as s,
        generate_subscripts(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) as nth from paras),
    sents as (select * from (select *, {NORM.format("s")} as key from pieces) where len(string_split(key, ' ')) >= 8)"""
_PIECES = f"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {NORM.format('s')}), lambda s: len(string_split(s, ' ')) >= 8)"
NEAR = f"""
    w as (select path, file_ord, start_line, string_split({NORM.format("text")}, ' ') as w, list_sort(list_distinct({_PIECES})) as keys from paras),
    sets as (select row_number() over (order by file_ord, start_line) as id, path, file_ord, start_line, keys, array_to_string(w[1:12], ' ') || ' …' as head,
        list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) as g from w where len(w) >= 25)"""
NEAR_PAIRS = """
    ex as (select id, unnest(g) as g from sets),
    shared as (select a.id as a, b.id as b, count(*) as n from ex a join ex b on a.g = b.g and a.id < b.id group by 1, 2),
    near as (select x.path as a_path, x.file_ord as a_ord, x.start_line as a_start_line, x.head, y.path as b_path, y.file_ord as b_ord, y.start_line as b_start_line,
        n / (len(x.g) + len(y.g) - n) as j from shared join sets x on x.id = a join sets y on y.id = b where x.path <> y.path and n / (len(x.g) + len(y.g) - n) >= 0.5)"""
NEAR_CLASSES = """
    classes as (select g, keys, min(id) as id, min(path) as low, max(path) as high from sets group by g, keys),
    ex as (select id, unnest(g) as g from classes),
    shared as (select a.id as a, b.id as b, count(*) as n from ex a join ex b on a.g = b.g and a.id < b.id group by 1, 2),
    near as (select p.path as a_path, p.start_line as a_start_line, r.path as b_path, r.start_line as b_start_line, n / (len(x.g) + len(y.g) - n) as j
        from shared join classes x on x.id = a join classes y on y.id = b join sets p on p.id = a join sets r on r.id = b
        where n / (len(x.g) + len(y.g) - n) >= 0.5 and least(x.low, y.low) <> greatest(x.high, y.high))"""

RECORD = "file_ord % 20 in (1, 4, 6, 7)"
SOURCE = "file_ord % 20 in (3, 5)"
COMMENTS = f"""
    known(raw, comment) as (select * from {values([(x[0], x[1]) for x in P.CODE + P.JS])}),
    code_lines as (select l.*, k.raw is not null as planted, k.comment,
        trim(regexp_replace(trim(case when path like '%.py' then substr(l.raw, 2) else substr(l.raw, 3) end), '^[#*/!]+', '')) as own
        from lines l left join known k on k.raw = l.raw where {SOURCE}),
    comments as (select file_ord, path, line_no, case when planted then comment else own end as comment from code_lines where case when planted then comment is not null else regexp_matches(own, '[A-Za-z]') end)"""
FIXED = "fixed(pack, raw, new, changes) as (select * from " + values(P.EDITED) + "), edits as (select pack, path, file_ord, line_no, raw as old, new, changes from lines join fixed using (raw) where " + MD + ")"
STRUCT = f"""
    depths as (select *, case when not f and not inside then length(regexp_extract(raw, '^(#{{1,6}})\\s+\\S', 1)) else 0 end as depth from (
        select *, sum(f::int) over (partition by file_ord order by line_no) % 2 = 1 as inside from (select *, s like '```%' or s like '~~~%' as f from md_lines))),
    next_lines as (select *, lead(depth) over w as after, lead(1) over w as nxt from depths where f or inside or s <> '' window w as (partition by file_ord order by line_no)),
    empties as (select path, file_ord, line_no as line, '0c' as class, 'empty section' as label, s as match, s as text, 4 as pass from next_lines where depth > 0 and (nxt is null or (after > 0 and after <= depth))),
    bold as (select file_ord, path, line_no, line_no - row_number() over (partition by file_ord order by line_no) as isle from md_lines where regexp_matches(raw, '^\\s*([-*+]|[0-9]+[.)])\\s+\\*\\*[^*]+\\*\\*')),
    bolds as (select path, file_ord, min(line_no) as line, '6' as class, 'bold-term bullet run' as label, count(*) || ' consecutive bullets' as match,
        count(*) || ' consecutive ''**Term**: …'' bullets starting here' as text, 5 as pass from bold group by path, file_ord, isle having count(*) >= 5),
    rules as (select *, lag(s) over (partition by file_ord order by line_no) as above from fenced),
    confetti as (select path, file_ord, min(line_no) as line, '6' as class, 'separator confetti' as label, count(*) || ' horizontal rules' as match,
        count(*) || ' horizontal rules in one document, first one here' as text, 6 as pass
        from rules where line_no > fm_end and not is_fence and not in_fence and s in ('---', '***', '___') and coalesce(above, '') = '' group by path, file_ord having count(*) >= 3),
    link(raw, target, up, rest) as (select * from {values(P.LINKS)}),
    folder_steps as (select file_ord, path, string_split(path, '/') as steps from corpus),
    there as (select distinct array_to_string(steps[1:n], '/') as p from (select steps, unnest(range(1, len(steps) + 1)) as n from folder_steps)),
    phantoms as (select l.path, l.file_ord, line_no as line, '0d' as class, 'phantom relative link' as label, target as match, l.raw as text, 3 as pass
        from prose l join link using (raw) join folder_steps f on f.file_ord = l.file_ord
        where array_to_string(list_concat(steps[1 : len(steps) - 1 - up], [rest]), '/') not in (select p from there))"""
SHOW = "select path, line, class, label, match, text from"


def _with(*parts: str, tail: str) -> str:
    return "with " + ",".join(parts) + "\n" + tail


R_, G_ = _expected(P.R), _expected(P.G)
_density = f"""
    standing as (select path, file_ord, case when {SOURCE} then (select count(*) from comments c where c.file_ord = corpus.file_ord) else (select len(s) from parts p where p.file_ord = corpus.file_ord) end as lines
        from corpus where not ({RECORD})),
    dens as (select path, file_ord, lines, (select count(*) from found_revision f where f.file_ord = standing.file_ord) as findings from standing)"""
_labels = lambda p: "(" + ", ".join(q(x) for x in P.SUPPRESSIBLE[p]) + ")"
_hits = " union all ".join(
    f"""select '{p}' as pack, path, line_no as line, label, match, label in ({", ".join(q(x) for x in P.GUIDE_LABELS)}) and path like '%quickstart%' as suppressed
        from lines join md_{p} using (raw) where {MD} and label in {_labels(p)}"""
    for p in (P.R, P.G)
) + f" union all select pack, path, line_no, label, match, true from lines join (select * from {values(P.SUPPRESSED)}) as x(pack, raw, label, match) using (raw) where {MD}"

ORACLES: dict[str, str] = {
    "corpus_records": _with(CORPUS, tail=f"select path, {RECORD} as is_record from corpus"),
    "corpus_kinds": _with(CORPUS, tail=f"select path, case when {SOURCE} then 'code' else 'markdown' end as kind from corpus"),
    "path_excludes": _with(CORPUS, tail="select path from corpus where path not like '%/src1/%' and path not like '%quick%' and path not like 'docs/en/src2/%'"),
    "corpus_split": _with(CORPUS, tail=f"select path, case when {SOURCE} then 'source' when {RECORD} then 'record' else 'kept' end as part from corpus"),
    "line_explode": _with(CORPUS, tail="select path, cast(line_no as int) as line_no, raw from lines"),
    "line_counts": _with(CORPUS, tail="select path, len(s) as lines from parts"),
    "front_matter": _with(CORPUS, tail=f"select path, cast(case when file_ord % 4 = 0 and file_ord % 20 <> 8 then 3 else 0 end as bigint) as fm_end from corpus where {MD}"),
    "fence_state": _with(CORPUS, STATES, tail="select path, cast(line_no as int) as line_no, is_fence, in_fence from fenced where is_fence or in_fence"),
    "html_comment_state": _with(CORPUS, STATES, tail="select path, cast(line_no as int) as line_no, in_comment from commented where in_comment or s like '<!--%'"),
    "prose_lines": _with(CORPUS, STATES, tail="select path, cast(line_no as int) as line_no, raw from prose"),
    "plain_text": _with(CORPUS, tail=f"select path, cast(line_no as int) as line_no, {PLAIN} as plain from lines where {MD}"),
    "normalised_text": _with(CORPUS, tail=f"select path, cast(line_no as int) as line_no, {NORM.format('raw')} as normalised, trim(regexp_replace(lower(raw), '[^a-z ]', '', 'g')) as key from lines where {MD}"),
    "code_comments": _with(CORPUS, COMMENTS, tail="select path, cast(line_no as int) as line_no, comment from comments"),
    "suppressed_hits": _with(CORPUS, R_, G_, tail=_hits),
    "path_suppressed": _with(CORPUS, R_, G_, tail=f"select * from ({_hits}) where label in ({', '.join(q(x) for x in P.GUIDE_LABELS)})"),
    "wrap_findings": _with(CORPUS, R_, G_, tail=" union all ".join(f"select '{p}' as pack, path, line, class, label, match, text from found_{p} where pass = 2" for p in (P.R, P.G))),
    "revision_findings": _with(CORPUS, R_, tail=f"{SHOW} found_revision"),
    "dedupe_first_wins": _with(
        CORPUS,
        STATES,
        G_,
        STRUCT,
        "every as (select path, file_ord, line, class, label, match, text, pass from found_generation union all select * from phantoms union all select * from empties union all select * from bolds union all select * from confetti)",
        tail=f"{SHOW} (select *, row_number() over (partition by file_ord, line, class order by pass) as nth from every) where nth = 1",
    ),
    "class_family_filter": _with(
        CORPUS,
        R_,
        tail="select w as wanted, (select count(*) from found_revision where class in (select unnest(c))) as findings from (values ('0', ['0a', '0b', '0c', '0d']), ('0.5', ['0.5']), ('1', ['1']), ('10', ['10']), ('0a', ['0a'])) as v(w, c)",
    ),
    "phantom_links": _with(CORPUS, STATES, STRUCT, tail=f"{SHOW} phantoms"),
    "empty_sections": _with(CORPUS, STATES, STRUCT, tail=f"{SHOW} empties"),
    "bold_runs": _with(CORPUS, STATES, STRUCT, tail=f"{SHOW} bolds"),
    "separator_confetti": _with(CORPUS, STATES, STRUCT, tail=f"{SHOW} confetti"),
    "emoji_decoration": _with(CORPUS, G_, tail=f"{SHOW} found_generation where label = 'emoji decoration'"),
    "collisions": _with(
        CORPUS,
        R_,
        tail="""select phrase, count(*) as count, string_agg(path || ':' || line, ', ' order by file_ord, line, pass) as sites
        from (select *, trim(regexp_replace(lower(match), '[^a-z ]', '', 'g')) as phrase from found_revision where class in ('6', '9')) where length(phrase) >= 8 group by phrase having count(distinct path) > 1 or count(*) > 2""",
    ),
    "paragraphs": _with(RAW, tail="select path, cast(start_line as int) as start_line, text from paras"),
    "planted_paragraphs": _with(CORPUS, STATES, _paras("prose"), tail="select path, cast(start_line as int) as start_line, text from paras"),
    "sentence_echoes": _with(RAW, SENTENCES, tail="select substr(key, 1, 100) as text, count(*) as count, string_agg(path || ':' || start_line, ', ' order by file_ord, start_line, nth) as sites from sents group by key having count(distinct path) > 1"),
    "sentence_echo_sites": _with(RAW, SENTENCES, tail="select key, path, cast(start_line as int) as start_line from sents where key in (select key from sents group by key having count(distinct path) > 1)"),
    "near_dup_echoes": _with(RAW, NEAR, NEAR_CLASSES, tail="select a_path, cast(a_start_line as int) as a_start_line, b_path, cast(b_start_line as int) as b_start_line, round_even(j, 2) as similarity from near"),
    "near_dup_members": _with(
        RAW,
        NEAR,
        "classes as (select g, keys, min(id) as first from sets group by g, keys)",
        tail="select s.path, cast(s.start_line as int) as start_line, f.path as class_path, cast(f.start_line as int) as class_line from sets s join classes c on c.g = s.g and c.keys = s.keys join sets f on f.id = c.first",
    ),
    "echoes_first_per_pair": _with(
        RAW,
        SENTENCES,
        NEAR,
        NEAR_PAIRS,
        "exact as (select distinct a.path as a_path, b.path as b_path from sents a join sents b on a.key = b.key and a.path <> b.path)",
        tail="""select head as text, cast(2 as bigint) as count, round_even(j, 2) as similarity, a_path || ':' || a_start_line || ', ' || b_path || ':' || b_start_line as sites
        from (select *, row_number() over (partition by a_path, b_path order by a_ord, a_start_line, b_ord, b_start_line) as nth from near anti join exact using (a_path, b_path)) where nth = 1""",
    ),
    "density": _with(CORPUS, R_, COMMENTS, _density, tail="select path, lines, findings, case when lines > 0 then round_even(100.0::double * findings / lines, 1) else 0.0::double end as per_100_lines from dens"),
    "clean_files": _with(CORPUS, R_, COMMENTS, _density, tail="select path from dens where findings = 0"),
    "cross_scanner_lines": _with(
        CORPUS,
        STATES,
        R_,
        G_,
        STRUCT,
        "every as (select path, file_ord, line, 'revision:' || class as c from found_revision union all select path, file_ord, line, 'generation:' || class from found_generation "
        + " ".join(f"union all select path, file_ord, line, 'generation:' || class from {t}" for t in ("phantoms", "empties", "bolds", "confetti"))
        + ")",
        tail=f"select path, cast(line as int) as line, array_to_string(list_sort(list(distinct c)), ', ') as classes from every where not ({RECORD}) group by path, file_ord, line",
    ),
    "class_roll_up": _with(CORPUS, R_, tail=f"select class, path, count(*) as findings from found_revision where not ({RECORD}) group by rollup(class, path)"),
    "class_totals": _with(CORPUS, R_, tail=f"select class, list_position([{', '.join(q(c) for c in REVISION.classes)}], class)::int as class_ord, count(*) as findings from found_revision where not ({RECORD}) group by class"),
    "report_totals": _with(
        CORPUS,
        R_,
        FIXED,
        tail=f"""select (select count(*) from found_revision where not ({RECORD}) and not ({SOURCE})) as findings, (select count(*) from corpus where not ({RECORD}) and not ({SOURCE})) as files,
        (select count(*) from corpus where {RECORD}) as records, (select count(*) from corpus where {SOURCE}) as source_files, (select count(*) from edits where pack = 'revision' and not ({RECORD})) as safe_fixes""",
    ),
    "safe_fixes": _with(CORPUS, FIXED, tail="select pack, path, cast(line_no as int) as line_no, old, new, changes from edits"),
    "fix_count": _with(CORPUS, FIXED, tail="select p as pack, (select count(*) from edits where pack = p) as safe_fixes from (values ('revision'), ('generation')) as v(p)"),
    "pleasantry_deletes": _with(CORPUS, FIXED, tail="select path, cast(line_no as int) as line_no, old from edits where new is null"),
    "heading_emoji_strip": _with(CORPUS, FIXED, tail="select path, cast(line_no as int) as line_no, old, new from edits where changes like '%emoji%'"),
    "rewritten_files": _with(
        CORPUS,
        FIXED,
        tail="""select pack, path, md5(string_agg(coalesce(new, raw) || case when brk in (chr(13), chr(13) || chr(10)) then chr(10) else brk end, '' order by line_no)) as content_md5 from (
        select p.pack, l.path, l.line_no, l.raw, l.brk, e.new, e.old from lines l join (select distinct pack, file_ord from edits) p on p.file_ord = l.file_ord
        left join edits e on e.pack = p.pack and e.file_ord = l.file_ord and e.line_no = l.line_no) where old is null or new is not null group by pack, path""",
    ),
}
ORACLES |= {name: _with(CORPUS, R_, tail=f"{SHOW} found_revision where class = {q(c)}") for name, (pack, c) in CLASS_QUERIES.items() if pack.name == P.R}
ORACLES |= {name: ORACLES["dedupe_first_wins"] + f" and class = {q(c)}" for name, (pack, c) in CLASS_QUERIES.items() if pack.name == P.G}
