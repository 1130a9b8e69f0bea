"""The queries as SQL for DuckDB, written apart from the DataFrame plans: windows where those read arrays, joins where those unfold lists."""

from __future__ import annotations

from prosa.functions import words as W
from prosa.plans.service import GREETING
from prosa.queries import LEGACY_TEXTS, QUERY, RULE_TEXTS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    return "(values " + ", ".join("(" + ", ".join(str(x) if isinstance(x, (int, float)) else quoted(x) for x in r) + ")" for r in rows) + ")"


def listed(items) -> str:
    return "(" + ", ".join(quoted(x) for x in items) + ")"


def texts(own) -> str:
    return f"(select doc_id, text from documents union all select * from {values((-1 - i, x) for i, x in enumerate(own))})"


PUNCT = r"[!\"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
PUNCT_DIGIT = r"[0-9!\"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
WORD = r"\p{L}+(?:[''’-]\p{L}+)*"
WHITE = r"[ \t\n\x0B\f\r]+"


def cut(text: str = "text") -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({text}, '([.!?]){WHITE}', '\1'||chr(1), 'g'), chr(1)), lambda x: trim(regexp_replace(x, '{WHITE}', ' ', 'g'))), lambda x: x <> '')"


def sents(source: str = "documents") -> str:
    return f"s as (select doc_id, unnest(l) as raw, unnest(range(len(l)))::int as sent_id from (select doc_id, {cut()} as l from {source}))"


TOKENS = f"t as (select doc_id, sent_id, raw, unnest(l) as token, unnest(range(len(l)))::int as pos from (select *, regexp_extract_all(raw, '{WORD}') as l from s))"
RAW_TOKENS = "t as (select doc_id, sent_id, unnest(l) as token, unnest(range(len(l)))::int as pos from (select *, string_split(raw, ' ') as l from s))"
ALL_STOPWORDS = sorted({x for own in W.STOPWORDS.values() for x in own})
ORDERED = "partition by doc_id, sent_id order by pos"

DOCS = f"with {sents()}, {TOKENS}"
RULED = f"with {sents(texts(RULE_TEXTS))}, {TOKENS}"
LEGACY = f"with {sents(texts(LEGACY_TEXTS))}, {RAW_TOKENS}"
UPPER = "(upper(token) = token and lower(token) <> token)"


def sentiment_sql(source: str, tail: str) -> str:
    """The valence rules one after another, on lags and leads over all words."""
    boosting = lambda k: f"case when lower(w{k}) in {listed(W.BOOSTERS)} then 0.293::double when lower(w{k}) in {listed(W.DAMPENERS)} then -0.293::double end"
    negated = lambda k: f"coalesce(w{k} in {listed(W.NEGATIONS)} or contains(w{k}, 'n''t'), false)"
    capital = lambda k: f"coalesce(upper(w{k}) = w{k} and lower(w{k}) <> w{k}, false)"
    opened = lambda k: f"(pos >= {k} and coalesce(l{k}, false) = false)"
    idiom = lambda x: "case " + " ".join(f"when {x} = {quoted(k)} then {v}::double" for k, v in W.IDIOMS.items()) + " end"
    damp = listed([x for x in W.BOOSTERS + W.DAMPENERS if " " in x])
    said = {}  # what a step adds to the descriptor, by number of the step
    add = lambda when, what: f"coalesce(case when {when} then ' ' || {what} end, '')"
    steps = ["select *, base + case when cap and " + UPPER + " then (case when base > 0 then 0.733 else -0.733 end) else 0 end as v, token as d from x where base is not null"]
    for k, factor in ((1, 1.0), (2, 0.95), (3, 0.9)):
        b = boosting(k)
        steps.append(f"case when {opened(k)} and ({b}) is not null then v + (({b}) * (case when v < 0 then -1 else 1 end) + case when cap and {capital(k)} then (case when v > 0 then 0.733 else -0.733 end) else 0 end) * {factor}::double else v end")
        said[len(steps) - 1] = add(f"{opened(k)} and ({b}) is not null", f"lower(w{k})")
        if k == 1:
            steps.append(f"case when {opened(1)} and {negated(1)} then v * -0.74 else v end")
            said[len(steps) - 1] = add(f"{opened(1)} and {negated(1)}", "w1")
        if k == 2:
            steps.append(f"case when {opened(2)} and coalesce(w2 = 'never', false) then (case when w1 in ('so', 'this') then v * 1.5 else v end) when {opened(2)} and {negated(2)} then v * -0.74 else v end")
            said[len(steps) - 1] = add(f"{opened(2)} and w2 = 'never' and w1 in ('so', 'this')", "'never ' || w1") + " || " + add(f"{opened(2)} and coalesce(w2 <> 'never', true) and {negated(2)}", "w2")
        if k == 3:
            steps.append(f"case when {opened(3)} and w3 = 'never' and w2 in ('so', 'this') then v * 1.25 else v end")
            said[len(steps) - 1] = add(f"{opened(3)} and w3 = 'never' and w2 in ('so', 'this')", "'never ' || w2")
            steps.append(f"case when {opened(3)} and w1 in ('so', 'this') then v * 1.25 else v end")
            said[len(steps) - 1] = add(f"{opened(3)} and w1 in ('so', 'this')", "w1")
            steps.append(f"case when {opened(3)} and {negated(3)} then v * -0.74 else v end")
            said[len(steps) - 1] = add(f"{opened(3)} and {negated(3)}", "w3")
            behind = [idiom(x) for x in ("w1||' '||token", "w2||' '||w1||' '||token", "w2||' '||w1", "w3||' '||w2||' '||w1", "w3||' '||w2")]
            steps.append(f"case when {opened(3)} then coalesce({', '.join(behind)}, v) else v end")
            steps.append(f"case when {opened(3)} then coalesce({idiom("token||' '||f1||' '||f2")}, {idiom("token||' '||f1")}, v) else v end")
            ahead = [(x, f"({idiom(x)}) is not null") for x in ("token||' '||f1", "token||' '||f1||' '||f2")]
            said[len(steps) - 1] = " || ".join(add(f"{opened(3)} and {when}", x) for x, when in ahead)
            steps.append(f"v - (case when {opened(3)} and w3||' '||w2 in {damp} then 0.293::double else 0 end) - (case when {opened(3)} and w2||' '||w1 in {damp} then 0.293::double else 0 end)")
    said[len(steps) - 1] = " || ".join(add(f"{opened(3)} and {x} in {damp}", x) for x in ("w3||' '||w2", "w2||' '||w1"))
    steps.append("case when lower(w1) = 'least' and not coalesce(l1, false) and (pos = 1 or (pos > 1 and lower(w2) not in ('at', 'very'))) then v * -0.74 else v end")
    said[len(steps) - 1] = add("lower(w1) = 'least' and not coalesce(l1, false) and (pos = 1 or (pos > 1 and lower(w2) not in ('at', 'very')))", "'least'")
    chain = [f"v0 as ({steps[0]})"] + [f"v{i} as (select * replace ({s} as v, d || {said.get(i, quoted(''))} as d) from v{i - 1})" for i, s in enumerate(steps[1:], 1)]
    names = ", ".join(f"lag(token, {k}) over o as w{k}, lag(known, {k}) over o as l{k}" for k in (1, 2, 3))
    return f"""with {sents(source)}, {TOKENS}, lx as (select * from {values(sorted(W.LEXICON.items()))} as q(term, val)),
      k as (select t.*, val::double as val, val is not null as known from t left join lx on lower(token) = term),
      n as (select *, {names}, lead(token, 1) over o as f1, lead(token, 2) over o as f2, sum(case when {UPPER} then 1 else 0 end) over g as ups, count(*) over g as n_words,
            min(case when token = 'but' then pos end) over g as b1, min(case when token = 'BUT' then pos end) over g as b2 from k window o as ({ORDERED}), g as (partition by doc_id, sent_id)),
      x as (select *, ups > 0 and ups < n_words as cap, coalesce(b1, b2) as but_at,
            case when lower(token) in {listed([*W.BOOSTERS, *W.DAMPENERS])} or (lower(token) = 'kind' and lower(f1) = 'of') then null else val end as base from n),
      {", ".join(chain)},
      hit as (select doc_id, sent_id, pos, token, d, v as before, case when pos < but_at then v * 0.5 when pos > but_at then v * 1.5 else v end as v from v{len(steps) - 1})
      {tail}"""


AMP = "(least(len(raw) - len(replace(raw, '!', '')), 4) * 0.292::double + case when len(raw) - len(replace(raw, '?', '')) <= 1 then 0 when len(raw) - len(replace(raw, '?', '')) <= 3 then (len(raw) - len(replace(raw, '?', ''))) * 0.18::double else 0.96::double end)"
POLARITY = f""", per as (select doc_id, sent_id, sum(v) as x, sum(case when v > 0 then v + 1 else 0 end) as up, sum(case when v < 0 then v - 1 else 0 end) as down, count(*) filter (v <> 0) as told from hit group by 1, 2),
      a as (select s.doc_id, s.sent_id, {AMP} as amp, len(regexp_extract_all(raw, '{WORD}')) as n, coalesce(x, 0::double) as x, coalesce(up, 0::double) as up, coalesce(down, 0::double) as down, coalesce(told, 0) as told from s left join per using (doc_id, sent_id)),
      b as (select *, x + case when x > 0 then amp when x < 0 then -amp else 0 end as c, case when up > abs(down) then up + amp else up end as p, abs(case when up < abs(down) then down - amp else down end) as m from a),
      pol as (select doc_id, sent_id, case when n > 0 then round(m / (p + m + n - told), 3) else 0 end as neg, case when n > 0 then round((n - told) / (p + m + n - told), 3) else 0 end as neu,
            case when n > 0 then round(p / (p + m + n - told), 3) else 0 end as pos, case when n > 0 then round(c / sqrt(c * c + 15), 4) else 0 end as compound from b)"""
NEUTRAL = f"filter (val is null and lower(token) not in {listed([*W.BOOSTERS, *W.DAMPENERS])} and not (lower(token) = 'kind' and coalesce(lower(f1) = 'of', false)))"
DESCRIBED = f""", sides as (select doc_id, sent_id, string_agg(d, '|' order by pos) filter (before > 0) as pos, string_agg(d, '|' order by pos) filter (before < 0) as neg from hit group by 1, 2),
      rest as (select doc_id, sent_id, string_agg(token, '|' order by pos) {NEUTRAL} as neu, count(*) {NEUTRAL} as n_neu from x group by 1, 2)
      select doc_id, sent_id, coalesce(pos, '') as pos, coalesce(neg, '') as neg, coalesce(neu, '') as neu, coalesce(n_neu, 0) as n_neu from s left join sides using (doc_id, sent_id) left join rest using (doc_id, sent_id)"""
LABEL = "case when abs(compound) < 0.1 then 'neutral' when compound > 0.8 then 'extremely positive' when compound > 0 then 'positive' when compound < -0.8 then 'extremely negative' when compound < 0 then 'negative' else '' end"
MEAN = lambda x, digits: f"sum(round({x} * {10**digits})::bigint)::double / (count(*) * {10**digits}::double)"
ROUNDED = lambda x, digits: f"floor(({x}) * {10**digits}::double + 0.5::double) / {10**digits}::double"
MEANS = f"select doc_id, {ROUNDED(MEAN('compound', 4), 6)} as compound, " + ", ".join(f"{ROUNDED(MEAN(c, 3) + ' * 100', 4)} as {name}" for c, name in (("pos", "positive"), ("neg", "negative"), ("neu", "neutral"))) + " from pol group by 1"

CONTENT = f"""c as (select * from (select doc_id, sent_id, raw, list_filter(list_transform(regexp_extract_all(raw, '{WORD}'), lambda x: lower(x)), lambda x: len(x) >= 2 and x not in {listed(ALL_STOPWORDS)}) as tokens from s) where len(tokens) > 2),
      tf as (select doc_id, sent_id, term, count(*) as tf from (select doc_id, sent_id, unnest(tokens) as term from c) group by 1, 2, 3)"""
WEIGHTED = f"""{CONTENT}, n as (select doc_id, count(*) as n from c group by 1), g as (select doc_id, term, ln(any_value(n)) / sum(tf) as idf, ln(any_value(n) / count(*)) as cidf from tf join n using (doc_id) group by 1, 2),
      w as (select doc_id, sent_id, term, tf * idf as w, tf * cidf as cw from tf join g using (doc_id, term)), norm as (select doc_id, sent_id, sqrt(sum(w * w)) as norm, sqrt(sum(cw * cw)) as cnorm from w group by 1, 2)"""
PAIRS = f"""{WEIGHTED}, pairs as (select a.doc_id, a.sent_id as i, b.sent_id as j, sum(a.w * b.w) / (any_value(x.norm) * any_value(y.norm)) as sim from w a join w b on a.doc_id = b.doc_id and a.term = b.term and a.sent_id < b.sent_id
      join norm x on x.doc_id = a.doc_id and x.sent_id = a.sent_id join norm y on y.doc_id = b.doc_id and y.sent_id = b.sent_id where x.norm > 0 and y.norm > 0 group by 1, 2, 3)"""
ADJACENT = f"""{PAIRS}, e as (select doc_id, i, j from pairs where round(sim, 9) > 0.1), adj as (select * from e union all select doc_id, j, i from e union all select distinct doc_id, sent_id, sent_id from w where w > 0),
      deg as (select doc_id, i as sent_id, count(*) as degree from adj group by 1, 2), score as (select doc_id, sent_id, raw, tokens, coalesce(degree, 0) as score from c left join deg using (doc_id, sent_id))"""
PHRASES = f"""{CONTENT}, p as (select doc_id, sent_id, unnest(tokens) as term, unnest(range(len(tokens)))::int as pos from c), q as (select *, lead(term) over ({ORDERED}) as following from p), n1 as (select term, count(*) as n from p group by 1),
      ab as (select term as a, following as b, count(*) as n_ab from q where following is not null group by 1, 2 having count(*) > 5),
      ph as (select a, b, n_ab, (n_ab - 5) * (select count(*) from n1)::double / (x.n * y.n) as score from ab join n1 x on a = x.term join n1 y on b = y.term where (n_ab - 5) * (select count(*) from n1)::double / (x.n * y.n) > 10)"""
MERGED = f"""{PHRASES}, fl as (select q.*, ph.a is not null as phrase from q left join ph on term = a and following = b),
      rn as (select *, pos - coalesce(max(case when not phrase then pos end) over ({ORDERED}), -1) as since from fl), tk as (select *, phrase and since % 2 = 1 as take from rn), gn as (select *, coalesce(lag(take) over ({ORDERED}), false) as gone from tk),
      mg as (select doc_id, sent_id, pos, case when take then term || '_' || following else term end as term from gn where not gone)"""
LEXRANK = f"""{PAIRS}, link as materialized (select doc_id, i, j from pairs where round(sim, 9) > 0.1 union all select doc_id, j, i from pairs where round(sim, 9) > 0.1 union all select doc_id, sent_id, sent_id from c),
      walk as materialized (select *, count(*) over (partition by doc_id, i) as degree from link),
      it as (select doc_id, sent_id, 0 as step, 1.0::double / count(*) over (partition by doc_id) as x, 1.0::double as moved from c
        union all select doc_id, sent_id, step, y, sqrt(sum((y - x) * (y - x)) over (partition by doc_id)) from
          (select it.doc_id, walk.j as sent_id, step + 1 as step, sum(x / degree) as y, max(case when i = j then x end) as x from it join walk on it.doc_id = walk.doc_id and it.sent_id = walk.i where moved > 0.001 group by 1, 2, 3)),
      lexrank as (select doc_id, sent_id, x / max(x) over (partition by doc_id) as score from (select *, max(step) over (partition by doc_id) as last from it) where step = last),
      placed as (select c.doc_id, c.sent_id, raw, row_number() over (partition by c.doc_id order by round(score, 9) desc, c.sent_id) as place from c join lexrank using (doc_id, sent_id)),
      summed as (select doc_id, string_agg(raw, ' ' order by sent_id) as summary from placed where place <= 5 group by 1)"""
CLASSIC_TAIL = PAIRS[len(CONTENT) :].replace("a.w * b.w", "a.cw * b.cw").replace("x.norm", "x.cnorm").replace("y.norm", "y.cnorm")
CLASSIC = CONTENT + CLASSIC_TAIL
ENDED = "select doc_id, sent_id, x / max(x) over (partition by doc_id) as score from (select *, max(step) over (partition by doc_id) as last from it) where step = last"
# edges of the reinforced walks: o is the organic chance (own: of staying), found the visits before a row in the first round, grown what a row's own visits add
VISITED = lambda pairs, own: f"""{pairs}, link as materialized (select doc_id, i, j from pairs where round(sim, 9) > 0.1 union all select doc_id, j, i from pairs where round(sim, 9) > 0.1 union all select doc_id, sent_id, sent_id from c),
      organic as (select *, case when i = j then {own}::double else 0.25::double / count(*) over (partition by doc_id, i) end as o, count(*) over (partition by doc_id, j) as degree, row_number() over (partition by doc_id, j order by i) as found from link),
      edge as materialized (select *, sum(o) over (partition by doc_id, i order by j) as grown, sum(o * found) over (partition by doc_id, i) as base, sum(o * degree) over (partition by doc_id, i) as slope from organic),
      size as materialized (select doc_id, count(*) as n from c group by 1)"""  # noqa: E731
DIVRANK = f"""{VISITED(PAIRS, 0.75)},
      it as (select doc_id, sent_id, 0 as step, 1.0::double / n as x, 1.0::double as moved from c join size using (doc_id)
        union all select doc_id, sent_id, step, y, sqrt(sum((y - x) * (y - x)) over (partition by doc_id)) from
          (select it.doc_id, it.sent_id, it.step + 1 as step, any_value(it.x) as x, 0.9::double * any_value(it.x) * sum(o * (found + it.step * degree + 1) / (base + it.step * slope + grown)) + 0.1::double / any_value(n) as y
           from it join edge on it.doc_id = edge.doc_id and it.sent_id = edge.i join size on size.doc_id = it.doc_id where moved > 0.001 group by 1, 2, 3)),
      ranked as ({ENDED})"""
# a scaled power method on chances by edge plus the same chance of every sentence
MIXED = lambda edges, anywhere: f"""{edges},
      it as (select doc_id, sent_id, 0 as step, 1.0::double / n as x, 1.0::double as moved from c join size using (doc_id)
        union all select doc_id, sent_id, step, y, sqrt(sum((y - x) * (y - x)) over (partition by doc_id)) from
          (select doc_id, sent_id, step, x, y / max(y) over (partition by doc_id) as y from
            (select doc_id, sent_id, step, x, along + {anywhere}::double / n * sum(x) over (partition by doc_id) as y from
              (select it.doc_id, chance.j as sent_id, it.step + 1 as step, sum(it.x * p) as along, max(case when i = j then it.x end) as x, any_value(n) as n
               from it join chance on it.doc_id = chance.doc_id and it.sent_id = chance.i join size on size.doc_id = it.doc_id where moved > 0.001 group by 1, 2, 3)))),
      ranked as (select doc_id, sent_id, round(score, 6) as score from ({ENDED}))"""  # noqa: E731
OLD_DIVRANK = MIXED(f"{VISITED(CLASSIC, 0.1)}, chance as materialized (select doc_id, i, j, 0.9::double * o * found / (base + grown - o) as p from edge)", 0.1)
OLD_LEXRANK = MIXED(
    f"""{CLASSIC}, link as (select doc_id, i, j, round(sim, 2) as v from pairs union all select doc_id, j, i, round(sim, 2) from pairs union all select doc_id, sent_id, sent_id, 1.0::double from c),
      scaled as (select doc_id, i, j, v / sum(v) over (partition by doc_id, j) as v from link), size as materialized (select doc_id, count(*) as n from c group by 1),
      chance as materialized (select doc_id, i, j, 0.15::double * v / sum(v) over (partition by doc_id, i) as p from scaled)""",
    0.85,
)
# the query is one more sentence of each document, number -1
OLD_SUMMARY = f"""{OLD_LEXRANK}, asked as (with c as (select doc_id, sent_id, tokens from own_c union all select distinct doc_id, -1, [{", ".join(map(quoted, QUERY))}] from own_c), {CONTENT[CONTENT.index("tf as") :]}{CLASSIC_TAIL} select * from pairs),
      r as (select *, row_number() over (partition by doc_id order by score desc, sent_id) as place from ranked),
      seen as (select a.doc_id, case when a.place > b.place then i else j end as sent_id, max(sim) as most from asked join r a on a.doc_id = asked.doc_id and a.sent_id = i join r b on b.doc_id = asked.doc_id and b.sent_id = j group by 1, 2),
      val as (select r.doc_id, r.sent_id, 0.7::double * (coalesce(sim, 0) - (1 - 0.7::double) * coalesce(most, 0)) as value from r left join seen on seen.doc_id = r.doc_id and seen.sent_id = r.sent_id left join asked on asked.doc_id = r.doc_id and asked.i = -1 and asked.j = r.sent_id),
      ends as (select *, min(value) over (partition by doc_id) as low, max(value) over (partition by doc_id) as high from val),
      final as (select doc_id, sent_id, round(case when high > low then (value - low) / (high - low) else 1 end, 6) as mmr from ends),
      best as (select own_c.doc_id, own_c.sent_id, raw, row_number() over (partition by own_c.doc_id order by mmr desc, own_c.sent_id) as place from own_c join final using (doc_id, sent_id))
      select doc_id, string_agg(raw, ' ' order by sent_id) as summary from best where place <= 3 group by 1"""
OLD_SUMMARY = OLD_SUMMARY.replace(CONTENT, f"{CONTENT}, own_c as (select * from c)", 1)
RECURSIVE = lambda sql: sql.replace("with ", "with recursive ", 1)
VOTES = "list_transform(regexp_extract_all(text, '" + WORD + "'), lambda x: lower(x))"
LANGS = sorted(W.STOPWORDS)
VOTED = f"v as (select doc_id, lang, text, {', '.join(f'len(list_filter({VOTES}, lambda x: x in {listed(W.STOPWORDS[k])})) as n_{k}' for k in LANGS)} from documents), d as (select *, greatest({', '.join(f'n_{k}' for k in LANGS)}) as most, {' + '.join(f'n_{k}' for k in LANGS)} as total from v), det as (select doc_id, lang, text, case when most = 0 then null {' '.join(f'when n_{k} = most then {quoted(k)}' for k in LANGS)} end as detected, case when total > 0 then round(most / total, 6) else 0 end as confidence from d)"
#: DuckDB's levenshtein counts bytes: letters beyond ASCII become upper-case letters, which lower-case terms don't hold.
ASCII = lambda x: f"translate({x}, 'äöüßàâçéèêëîïôûùñóíáúœ’', 'ABCDEFGHIJKLMNOPQRSTUVWX')"
VOCABULARY = "(select term, count(*) as df from (select distinct doc_id, lower(token) as term from t) group by 1)"
CONTRACTED = (
    "array_to_string(list_transform(string_split(text, ' '), lambda x: case when contains(x, '''') or lower(regexp_replace(x, '[.,;:!?]*$', '')) in ('gonna', 'gotta') then coalesce((case lower(regexp_replace(x, '[.,;:!?]*$', '')) "
    + " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in W.CONTRACTIONS.items())
    + " end) || regexp_extract(x, '[.,;:!?]*$'), x) else x end), ' ')"
)
ENTITIES = "replace(replace(replace(regexp_replace(html, '&quot;?', '\"', 'g'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160))"
GERMAN = {"und": "and", "der": "the", "die": "the", "das": "the", "nicht": "not", "ist": "is"}

LEMMAS = f"""{RULED}, u as (select doc_id, sent_id, pos, token, lower(token) as low, upper(token) = token and lower(token) <> token as up, upper(token[1]) || lower(token[2:]) = token and len(token) > 1 and lower(token) <> token as title from t),
      k as (select *, case when regexp_matches(low, '^[0-9]') or low in {listed(W.NUMBER_WORDS)} then 'NUM' when low in {listed(W.STOPWORDS['en'])} then 'DET' when low like '%ly' then 'ADV' when regexp_matches(low, '(ous|ful|ive|able|ible|al|ic|less|ish)$') then 'ADJ'
            when regexp_matches(low, '(ing|ed|ize|ise|ify)$') then 'VERB' when title then 'PROPN' else 'NOUN' end as class,
            case when regexp_matches(low, '[^aeiou]ies$') then regexp_replace(low, 'ies$', 'y') when regexp_matches(low, '(ss|sh|ch|x|z)es$') then regexp_replace(low, 'es$', '') when regexp_matches(low, '[^s]s$') and len(low) > 3 then regexp_replace(low, 's$', '')
            when regexp_matches(low, '[aeiou].*ing$') and len(low) > 5 then regexp_replace(low, 'ing$', '') when regexp_matches(low, '[aeiou].*ed$') and len(low) > 4 then regexp_replace(low, 'ed$', '') else low end as base from u)"""

ORACLE_SQL = {
    "sentence_split": f"with {sents()} select doc_id, sent_id, raw from s",
    "sentence_count": f"select doc_id, len({cut()})::bigint as n_sentences from documents",
    "partition_batches": f"with {sents()} select doc_id, (sent_id // 200)::int as part_id, count(*) as n_sentences, md5(string_agg(raw, ' ' order by sent_id)) as digest from s group by 1, 2",
    "token_explode": f"{DOCS} select doc_id, sent_id, pos, token from t",
    "token_filter_chain": f"with {sents(texts(RULE_TEXTS))}, {RAW_TOKENS} select * from t where not regexp_matches(token, '{PUNCT_DIGIT}') and len(token) >= 2 and lower(token) not in {listed(W.NUMBER_WORDS)} and not regexp_matches(token, '^(?:https?://|www\\.)') and lower(token) not in {listed(W.STOPWORDS['en'])}",
    "token_annotations": f"""{LEMMAS}
      select doc_id, count(*) as n_tokens, count(distinct base) as n_lemmas, sum(up::int)::bigint as is_upper, sum(title::int)::bigint as is_title, sum((low in {listed(W.STOPWORDS['en'])})::int)::bigint as is_stop, sum((low in {listed(W.NUMBER_WORDS)})::int)::bigint as like_number from k group by 1""",
    "min_length_filter": f"{DOCS} select doc_id, count(*) as n_tokens from t where len(token) >= 3 group by 1",
    "special_char_filter": f"with {sents()}, {RAW_TOKENS} select doc_id, count(*) as n_tokens from t where not regexp_matches(token, '{PUNCT_DIGIT}') group by 1",
    "stopword_anti": f"{DOCS} select doc_id, count(*) as n_tokens from t where lower(token) not in {listed(ALL_STOPWORDS)} group by 1",
    "vocab_semi": f"{DOCS} select doc_id, count(*) as n_tokens from t where lower(token) in (select term from {VOCABULARY} where df >= 20) group by 1",
    "min_tokens_sentences": f"with {sents()}, {CONTENT} select doc_id, sent_id, len(tokens)::bigint as n_tokens, array_to_string(tokens, ' ') as tokens from c",
    "case_flags": f"{RULED} select doc_id, sum(case when {UPPER} then 1 else 0 end)::bigint as upper, sum(case when lower(token) = token then 1 else 0 end)::bigint as lower, count(*) as n_tokens from t group by 1",
    "case_handling": f"""{LEMMAS}
      select class, count(*) as n_tokens, count(distinct case when up then upper(base) when title then upper(base[1]) || lower(base[2:]) else base end) as n_forms from k group by 1""",
    "repeat_squeeze": f"""{DOCS}, u as (select distinct lower(token) as term from t), d as (select term, list_max(list_filter(range(1, len(term)), lambda i: term[i] = term[i + 1] and term[i] not in ('-', '''', '’'))) as spot from u)
      select term, substr(term, 1, spot) || substr(term, spot + 2) as squeezed from d where spot is not null""",
    "legacy_normalize": f"""with {sents(texts(LEGACY_TEXTS))}, k as (select doc_id, sent_id, list_filter(string_split(raw, ' '), lambda x: (regexp_replace(x, '{PUNCT}', '', 'g') = '' and x <> '') or (regexp_replace(x, '{PUNCT}', '', 'g') <> '' and len(x) >= 2)) as l from s)
      select doc_id, sent_id, array_to_string(list_filter(list_transform(l, lambda x: case when regexp_replace(x, '{PUNCT}', '', 'g') = '' then x
        when len(regexp_extract(regexp_replace(x, '^[^\\p{{L}}\\p{{N}}_]+', ''), '^[\\p{{L}}\\p{{N}}_''’-]+([?!]+)$', 1)) >= 4 then regexp_replace(x, '^[^\\p{{L}}\\p{{N}}_]+', '')
        else regexp_extract(regexp_replace(x, '^[^\\p{{L}}\\p{{N}}_]+', ''), '^(.*[\\p{{L}}\\p{{N}}_])', 1) end), lambda x: x <> ''), ' ') as tokens from k""",
    "levenshtein_suggest": f"""{DOCS}, known as (select term from {VOCABULARY} where df >= 50),
      asked as (select distinct lower(unnest(regexp_extract_all(text, '{WORD}'))) as term from benchmark), un as (select term from asked where term not in (select term from known)),
      met as (select un.term, known.term as word, levenshtein({ASCII('un.term')}, {ASCII('known.term')})::int as edits from un, known where abs(len(un.term) - len(known.term)) <= 2 and levenshtein({ASCII('un.term')}, {ASCII('known.term')}) <= 2)
      select term, arg_min(word, edits * 1000000 + place) as suggestion, min(edits) as edits from (select *, row_number() over (partition by term order by word) as place from met) group by 1""",
    "html_unescape_pages": f"select page_id, md5(regexp_replace({ENTITIES}, '&amp;?', '&', 'g')) as digest from pages",
    "html_strip_pages": f"select page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^<>]*>', ' ', 'g'), '{WHITE}', ' ', 'g'))) as digest from pages",
    "contraction_expand": f"select doc_id, md5({CONTRACTED}) as digest from {texts(RULE_TEXTS)}",
    "punct_emphasis": f"""{LEGACY} select doc_id, sent_id, pos, token, case when len(regexp_extract(token, '^[\\p{{L}}\\p{{N}}_''’-]+([?!]+)$', 1)) >= 4 then token else regexp_extract(token, '^(.*[\\p{{L}}\\p{{N}}_])', 1) end as shaped from t where regexp_matches(token, '[?!]$')""",
    "legacy_special_tokens": f"{LEGACY} select * from t where regexp_replace(token, '{PUNCT}', '', 'g') = ''",
    "append_union": f"select doc_id, (len({cut()}) + 1)::bigint as last_id, (len({cut()}) + 2)::bigint as n_sentences, ':) More follows.' as last from documents",
    "lexicon_join": f"{RULED} select doc_id, count(*) as n_hits, round(sum(val::double), 4) as valence, round(avg(val::double), 6) as mean_valence from t join {values(sorted(W.LEXICON.items()))} as q(term, val) on lower(token) = term group by 1",
    "sentence_valence": sentiment_sql(texts(RULE_TEXTS), "select doc_id, sent_id, round(sum(v), 6) as valence from hit group by 1, 2 having round(sum(v), 6) <> 0"),
    "word_valence": sentiment_sql(texts(RULE_TEXTS), "select doc_id, sent_id, pos, lower(token) as term, round(before, 6) as valence from hit"),
    "cap_differential": f"{RULED} select doc_id, sent_id from t group by 1, 2 having sum(case when {UPPER} then 1 else 0 end) between 1 and count(*) - 1",
    "booster_lookback": sentiment_sql(texts(RULE_TEXTS), "select doc_id, sent_id, pos, round(boost, 6) as boost from (select *, " + " + ".join(f"coalesce(case when lower(w{k}) in {listed(W.BOOSTERS)} then 0.293::double when lower(w{k}) in {listed(W.DAMPENERS)} then -0.293::double end, 0)" for k in (1, 2, 3)) + " as boost from x where base is not null) where round(boost, 6) <> 0"),
    "negation_lookback": sentiment_sql(texts(RULE_TEXTS), "select doc_id, sent_id, pos, n_negations from (select *, " + " + ".join(f"(coalesce(w{k} in {listed(W.NEGATIONS)} or contains(w{k}, 'n''t'), false))::bigint" for k in (1, 2, 3)) + " as n_negations from x where base is not null) where n_negations > 0"),
    "idiom_match": f"{RULED} select doc_id, sent_id, pos, idiom from (select *, token || ' ' || lead(token) over ({ORDERED}) as idiom from t) where idiom in {listed(W.IDIOMS)}",
    "but_rule": f"{RULED} select doc_id, sent_id, coalesce(min(case when token = 'but' then pos end), min(case when token = 'BUT' then pos end))::bigint as at from t where token in ('but', 'BUT') group by 1, 2",
    "punct_amplifier": f"with {sents(texts(RULE_TEXTS))} select doc_id, sent_id, round({AMP}, 6) as amp from s where {AMP} > 0",
    "sentence_polarity": sentiment_sql(texts(RULE_TEXTS), POLARITY + " select * from pol"),
    "document_sentiment": sentiment_sql(texts(RULE_TEXTS), POLARITY + " " + MEANS),
    "sentiment_labels": sentiment_sql(texts(RULE_TEXTS), POLARITY + f" select {LABEL} as label, count(*) as n_sentences from pol group by 1"),
    "descriptors": sentiment_sql(texts(RULE_TEXTS), DESCRIBED),
    "lexrank_scores": RECURSIVE(f"with {sents()}, {LEXRANK} select doc_id, sent_id, round(score, 6) as score from lexrank"),
    "lexrank_summary": RECURSIVE(f"with {sents()}, {LEXRANK} select * from summed"),
    "divrank_scores": RECURSIVE(f"with {sents()}, {DIVRANK} select doc_id, sent_id, round(score, 6) as score from ranked"),
    "legacy_lexrank": RECURSIVE(f"with {sents()}, {OLD_LEXRANK} select * from ranked"),
    "legacy_divrank": RECURSIVE(f"with {sents()}, {OLD_DIVRANK} select * from ranked"),
    "legacy_summary": RECURSIVE(f"with {sents()}, {OLD_SUMMARY}"),
    "analysis_report": f"""select doc_id, len({cut()})::int as n_sentences, detected, compound, positive, negative, neutral, summary, case when compound is not null then {LABEL} end as label
      from (with {VOTED} select doc_id, text, detected from det) left join ({sentiment_sql("documents", POLARITY + " " + MEANS)}) using (doc_id) left join ({RECURSIVE(f"with {sents()}, {LEXRANK} select * from summed")}) using (doc_id)""",
    "char_batches": r"""with recursive w as (select doc_id, unnest(l) as word, unnest(range(len(l))) as pos from (select doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as l from documents)),
      s as materialized (select doc_id, sum(len(word) + 1) over (partition by doc_id order by pos)::bigint as upto from w),
      b as (select doc_id, 0 as batch, 0::bigint as base, coalesce(min(upto) filter (upto > 4500), max(upto)) as upto from s group by 1
        union all select b.doc_id, b.batch + 1, b.upto, coalesce(min(s.upto) filter (s.upto - b.upto > 4500), max(s.upto)) from b join s on s.doc_id = b.doc_id and s.upto > b.upto group by 1, 2, 3)
      select doc_id, batch, (upto - base)::int as n_chars from b""".replace("\\\\", "\\"),
    "pooled_translation": rf"""with recursive w as (select doc_id, unnest(l) as word, unnest(range(len(l))) as pos from (select doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as l from documents)),
      s as materialized (select doc_id, word, pos, sum(len(word) + 1) over (partition by doc_id order by pos)::bigint as upto from w),
      b as (select doc_id, 0 as batch, 0::bigint as base, coalesce(min(upto) filter (upto > 4500), max(upto)) as upto from s group by 1
        union all select b.doc_id, b.batch + 1, b.upto, coalesce(min(s.upto) filter (s.upto - b.upto > 4500), max(s.upto)) from b join s on s.doc_id = b.doc_id and s.upto > b.upto group by 1, 2, 3)
      select s.doc_id, batch, md5(' ' || string_agg(case lower(word) {' '.join(f'when {quoted(k)} then {quoted(v)}' for k, v in GERMAN.items())} else word end, ' ' order by pos)) as digest from s join b on s.doc_id = b.doc_id and s.upto > b.base and s.upto <= b.upto group by 1, 2""",
    "progress_read": "select c_custkey as user_id, coalesce(round(value, 6), 0) as percentage from customer left join (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as place from events) on user_id = c_custkey and place = 1",
    "valid_requests": "select event_id, user_id as api_key from events where user_id in (select c_custkey from customer where c_acctbal > 0)",
    "bigram_term_frequency": f"with {sents()}, {CONTENT}, gram as (select unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) as term from c) select term, count(*) as n from gram group by 1 having count(*) > 1",
    "legacy_normalize_defaults": f"""with {sents(texts(LEGACY_TEXTS))}, k as (select doc_id, sent_id, list_filter(regexp_extract_all(raw, '{WORD}|[^\\p{{L}}\\s]+'), lambda x: regexp_replace(x, '{PUNCT}', '', 'g') <> '' and len(x) >= 2) as l from s)
      select doc_id, sent_id, array_to_string(list_filter(list_transform(l, lambda x: lower(regexp_extract(regexp_replace(x, '^[^\\p{{L}}\\p{{N}}_]+', ''), '^(.*[\\p{{L}}\\p{{N}}_])', 1))), lambda x: x <> '' and x not in {listed([*W.STOPWORDS["en"], "n't", "'s", "'d", "'t", "'ve", "'ll"])}), ' ') as tokens from k""",
    "normalize_chain": f"""{LEMMAS}, own as (select doc_id, sent_id, pos, base from k where class in {listed(W.BASE_CLASSES)} and len(token) >= 2 and low not in {listed(W.NUMBER_WORDS)} and low not in {listed(W.STOPWORDS["en"])} and not regexp_matches(token, '{PUNCT_DIGIT}'))
      select doc_id, sent_id, string_agg(base, ' ' order by pos) as tokens from own group by 1, 2 having count(*) > 2""",
    "conversation_sentiment": sentiment_sql("(select conv_id || '/' || turn as doc_id, text from conversations)", POLARITY + f", dm as ({MEANS}) select c.conv_id, c.role, count(*) as n_turns, {ROUNDED(MEAN('compound', 6), 4)} as compound from conversations c join dm on dm.doc_id = c.conv_id || '/' || c.turn group by 1, 2"),
    "term_frequency": f"with {sents()}, {CONTENT} select * from tf",
    "collection_idf": f"with {sents()}, {WEIGHTED} select doc_id, term, round(idf, 6) as idf from g",
    "classic_idf": f"with {sents()}, {WEIGHTED} select doc_id, term, round(cidf, 6) as idf from g",
    "tfidf_weights": f"with {sents()}, {WEIGHTED} select doc_id, sent_id, term, round(w, 6) as weight from w",
    "sentence_norms": f"with {sents()}, {WEIGHTED} select doc_id, sent_id, round(norm, 6) as norm from norm",
    "cosine_pairs": f"with {sents()}, {PAIRS} select doc_id, i, j, round(sim, 6) as sim from pairs",
    "cosine_threshold_edges": f"with {sents()}, {PAIRS} select doc_id, i, j from pairs where round(sim, 9) > 0.1",
    "legacy_cosine_2dp": f"with {sents()}, {CLASSIC} select doc_id, count(*) as n_pairs, round(sum(sim), 4) as total, sum(case when round(sim, 2) > 0.1 then 1 else 0 end)::bigint as n_above from pairs group by 1",
    "row_stochastic": f"with {sents()}, {ADJACENT} select doc_id, i, j, round(1.0::double / count(*) over (partition by doc_id, i), 6) as p from adj",
    "degree_centrality": f"with {sents()}, {ADJACENT} select * from deg",
    "topk_summary": f"with {sents()}, {ADJACENT}, r as (select *, row_number() over (partition by doc_id order by score desc, sent_id) as place from score) select doc_id, md5(string_agg(raw, ' ' order by sent_id)) as digest from r where place <= 3 group by 1",
    "topk_summary_reversed": f"with {sents()}, {ADJACENT}, r as (select *, row_number() over (partition by doc_id order by score desc, sent_id) as place from score) select doc_id, md5(string_agg(raw, ' ' order by sent_id desc)) as digest from r where place <= 3 group by 1",
    "mmr_rerank": f"""with {sents()}, {ADJACENT}, r as (select *, row_number() over (partition by doc_id order by score desc, sent_id) as place, len(list_filter(list_distinct(tokens), lambda x: x in {listed(QUERY)})) / len(list_distinct(tokens)) as sim_q from score),
      seen as (select later as sent_id, doc_id, max(sim) as most from (select pairs.*, case when a.place > b.place then i else j end as later from pairs join r a on a.doc_id = pairs.doc_id and a.sent_id = i join r b on b.doc_id = pairs.doc_id and b.sent_id = j) group by 1, 2),
      val as (select r.doc_id, r.sent_id, 0.7::double * (sim_q - (1 - 0.7::double) * coalesce(most, 0)) as value from r left join seen using (doc_id, sent_id)),
      ends as (select *, min(value) over (partition by doc_id) as low, max(value) over (partition by doc_id) as high from val) select doc_id, sent_id, round(case when high > low then (value - low) / (high - low) else 1 end, 5) as mmr from ends""",
    "query_similarity_filter": f"""with {sents()}, {CONTENT}, m as (select doc_id, sent_id, sum(case when term in {listed(QUERY)} then tf else 0 end) / (sqrt(sum(tf * tf)) * sqrt({len(QUERY)})) as cosine from tf group by 1, 2) select doc_id, sent_id, round(round(cosine, 6), 5) as cosine from m where round(cosine, 6) >= 0.1""",
    "embedding_query_topk": "with q as (select embedding::double[] as q from embeddings where vec_id = 0), x as (select vec_id, round(list_cosine_similarity(embedding::double[], q), 5) as cosine from embeddings, q) select * from x order by cosine desc, vec_id limit 20",
    "bigram_scores": f"with {sents()}, {PHRASES} select a, b, n_ab, round(score, 5) as score from ph",
    "phrase_merge": f"with {sents()}, {MERGED} select * from mg",
    "bow_counts": f"with {sents()}, {MERGED} select doc_id, sent_id, term, count(*) as n from mg group by 1, 2, 3",
    "language_vote": f"with {VOTED} select doc_id, detected, round(confidence, 4) as confidence from det",
    "language_accuracy": f"with {VOTED} select lang, count(*) as n_docs, sum(case when detected = lang then 1 else 0 end)::bigint as n_right from det group by 1",
    "language_filter": f"with {VOTED} select doc_id from det where detected = 'en' and confidence >= 0.9",
    "conditional_translation": f"with {VOTED}, tr as (select doc_id, array_to_string(list_transform(string_split(text, ' '), lambda x: case lower(x) {' '.join(f'when {quoted(k)} then {quoted(v)}' for k, v in GERMAN.items())} else x end), ' ') as text from det where detected = 'de' and confidence >= 0.9) select doc_id, md5(({cut()})[1]) as digest from tr where len({cut()}) > 0",
    "progress_latest": "select user_id, strftime(ts, '%Y-%m-%d %H:%M') as at, round(value, 6) as percentage from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as place from events) where place = 1",
    "progress_reset": "select user_id, case when user_id in (select user_id from events where event_type = 'error') then '' else strftime(ts, '%Y-%m-%d %H:%M') end as at, case when user_id in (select user_id from events where event_type = 'error') then 0 else round(value, 6) end as percentage from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as place from events) where place = 1",
    "progress_schedule": "select (i)::int as step, round(30.0::double / (7 - i), 2) as percentage from range(7) r(i) union all select 7, 37.5 union all select 8, 45.0 union all select (9 + i)::int, round(45 + 50.0::double / (10 - i), 2) from range(10) r(i) union all select 19, 100.0",
    "run_metrics": f"select count(*) as documents, sum(len({cut()}))::bigint as sentences, sum(len(regexp_extract_all(text, '{WORD}')))::bigint as words from documents",
    "service_greeting": f"select {quoted(GREETING)} as answer",
    "init_options": """select c_custkey as api_key, '{"Language":{"ENGLISH":"en","FRENCH":"fr","GERMAN":"de","SPANISH":"es"},"KEY":"' || c_custkey || '"}' as options from customer""",
    "validate_answers": "select event_id, ok as valid, case when ok then '<h1>Valid API Key</h1>' else '<h1>Invalid API Key</h1>' end as answer from (select event_id, coalesce(user_id in (select c_custkey from customer where c_acctbal > 0), false) as ok from events)",
    "shown_documents": f"""with {sents()}, {CONTENT}, l as (select doc_id, string_agg(chr(9) || '[' || array_to_string(tokens, ', ') || ']' || chr(10), '' order by sent_id) as lines, string_agg(array_to_string(tokens, ', '), ', ' order by sent_id) as every from c group by 1)
      select doc_id, md5('Normalized Sentences' || chr(10) || coalesce(lines, '') || 'Tokens' || chr(10) || chr(9) || '[' || coalesce(every, '') || ']') as digest from documents left join l using (doc_id)""",
    "language_options": "select * from (values ('ENGLISH', 'en'), ('FRENCH', 'fr'), ('GERMAN', 'de'), ('SPANISH', 'es')) as q(name, code)",
}
