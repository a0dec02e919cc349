"""Fixed values of the SQL, written out from the survey and apart from the engine's own, so that each holds the other to account."""

from __future__ import annotations

# Scale words.
SCALE_MAP = """map {'hundred': 1e2::double, 'thousand': 1e3::double, 'k': 1e3::double, 'lakh': 1e5::double, 'lakhs': 1e5::double, 'lac': 1e5::double, 'lacs': 1e5::double,
    'million': 1e6::double, 'millions': 1e6::double, 'mn': 1e6::double, 'mln': 1e6::double, 'm': 1e6::double, 'crore': 1e7::double, 'crores': 1e7::double, 'cr': 1e7::double,
    'billion': 1e9::double, 'billions': 1e9::double, 'bn': 1e9::double, 'b': 1e9::double, 'trillion': 1e12::double, 'tn': 1e12::double, 'tr': 1e12::double}"""
SCALE_WORDS = "thousand|trillion|billions|millions|billion|hundred|million|crores|crore|lakhs|lacs|lakh|lac|mln|bn|cr|mn|tn|tr|b|k|m"
# Currency markers.
CURRENCY_MAP = "map {'₹': 'INR', 'rs': 'INR', 'rs.': 'INR', 'inr': 'INR', '$': 'USD', 'us$': 'USD', 'usd': 'USD', '€': 'EUR', 'eur': 'EUR', '£': 'GBP', 'gbp': 'GBP', '¥': 'JPY', 'jpy': 'JPY', 'aed': 'AED', 'sgd': 'SGD', 'cny': 'CNY', 'rmb': 'CNY'}"
CURRENCY = r"us\$|[₹$€£¥]|rs\.?|inr|usd|eur|gbp|jpy|aed|sgd|cny|rmb"
# Nouns of mass and duration, one of each in the singular.
NOUNS = """map {'kg': 1.0::double, 'kilogram': 1.0::double, 'ton': 1000.0::double, 'tonne': 1000.0::double, 'mt': 1000.0::double, 'day': 1.0::double, 'week': 7.0::double, 'month': 30.436875::double, 'year': 365.25::double}"""
MASS = "'kg', 'kilogram', 'ton', 'tonne', 'mt'"
# Words without meaning in a measure, words that make another measure.
STOPWORDS = """'a', 'an', 'the', 'of', 'in', 'for', 'on', 'at', 'to', 'from', 'by', 'with', 'and', 'or', 'as', 'its', 'their', 'this', 'that', 'these', 'those', 'rate', 'value', 'amount',
    'figure', 'level', 'number', 'quantum', 'size', 'is', 'was', 'are', 'were', 'be', 'been', 'being'"""
MARKERS = """'growth', 'change', 'increase', 'decrease', 'decline', 'rise', 'fall', 'expansion', 'contraction', 'reduction', 'addition', 'accretion', 'drawdown', 'depletion', 'share', 'proportion', 'percentage', 'margin',
    'ratio', 'contribution', 'weight', 'per', 'capita', 'average', 'mean', 'median', 'cumulative', 'incremental', 'net', 'gross', 'forecast', 'projection', 'target', 'estimate'"""
# Words around names.
HONORIFICS = "'mr', 'mrs', 'ms', 'miss', 'dr', 'prof', 'shri', 'smt', 'sri', 'sh', 'hon', 'justice', 'capt', 'col', 'gen', 'rev', 'sir'"
SUFFIXES = """'limited', 'ltd', 'llp', 'llc', 'inc', 'incorporated', 'corp', 'corporation', 'plc', 'pvt', 'private', 'co', 'company', 'gmbh', 'sa', 'nv', 'bv', 'ag', 'holdings', 'group', 'and', '&'"""
ARTICLES = "'the', 'of', 'a', 'an'"
POINTING = "'the company', 'our company', 'the group', 'the bank', 'the issuer', 'the corporation', 'we', 'us', 'the organisation', 'the organization'"
# Months.
MONTH_MAP = """map {'jan': 1, 'january': 1, 'feb': 2, 'february': 2, 'mar': 3, 'march': 3, 'apr': 4, 'april': 4, 'may': 5, 'jun': 6, 'june': 6, 'jul': 7, 'july': 7, 'aug': 8, 'august': 8,
    'sep': 9, 'sept': 9, 'september': 9, 'oct': 10, 'october': 10, 'nov': 11, 'november': 11, 'dec': 12, 'december': 12}"""
MONTHS = "september|february|november|december|january|october|august|march|april|june|july|sept|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
FULL_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
# Wordings that tell the month a fiscal year ends in, with their weights. ``S`` is a blank of any kind.
HINTS = (
    (r"(?i)(?:financial|fiscal)S+yearS+ende[dr]S+(?:onS+)?(?:\d{1,2}S+)?(MONTHS)\b", 5.0),
    (r"(?i)\byearS+endedS+(?:\d{1,2}S+)?(MONTHS)S+\d{1,2},?S*\d{4}\b", 1.0),
    (r"(?i)\byearS+endingS+(?:\d{1,2}S+)?(MONTHS)\b", 1.0),
    (r"(?i)\basS+(?:on|at)S+(?:\d{1,2}S+)?(MONTHS)S+\d{1,2},?S*\d{4}\b", 0.25),
)
BLANK = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def hint(pattern: str) -> str:
    out = pattern.replace("MONTHS", MONTHS)
    return out.replace("S+", BLANK + "+").replace("S*", BLANK + "*")


def trimmed(x: str) -> str:
    """A text without outer blanks of any kind."""
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


# Words that make a passage dense. Marks between words are doubled first, so that neighbours both count.
DENSE = (
    "per  cent|percent|crore|lakh|million|billion|trillion|revenue|growth|increase|increased|decrease|decreased|total|net|margin|ratio|rate|share|as  on|as  at|"
    "appointed|resigned|ceased|effective  from|compared|versus|vs|estimated|projected|stood  at|reached|declined|rose|fell"
)


def density(x: str) -> str:
    apart = f"(' ' || regexp_replace(lower({x}), '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g') || ' ')"
    joined = f"regexp_replace({x}, '([\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g')"
    n, d = f"length({x})", f"length(regexp_replace({x}, '\\P{{Nd}}', '', 'g'))"
    k = f"(len(regexp_extract_all({apart}, '[^\\p{{L}}\\p{{N}}_](?:{DENSE})[^\\p{{L}}\\p{{N}}_]')) + len(regexp_extract_all({joined}, '[\\p{{L}}\\p{{N}}_]%[\\p{{L}}\\p{{N}}_]')))"
    score = f"(0.55::double * least(1.0::double, 6.0::double * {d} / {n}) + 0.45::double * least(1.0::double, {k} / 6.0::double))"
    return f"(case when {trimmed(x)} <> '' then round_even(least(1.0::double, case when {n} < 60 then {score} * 0.4::double else {score} end) * 10000, 0) / 10000 else 0.0 end)"


def heading(x: str) -> str:
    t = trimmed(x)
    letters, upper = f"length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g'))", f"length(regexp_replace({t}, '[^\\p{{Lu}}]', '', 'g'))"
    words = f"len(list_filter(regexp_split_to_array({t}, '{BLANK}+'), lambda w: w <> ''))"
    line = rf"regexp_matches({t}, '^(?:\p{{Nd}}+(?:\.\p{{Nd}}+)*\.?{BLANK}+)?[A-Z][A-Za-z ,''\-&/()]+$')"
    return f"({t} <> '' and length({t}) <= 120 and not regexp_matches({t}, '[.;,]$') and {words} <= 14 and (({letters} > 0 and {upper} > {letters} * 0.6) or {line}))"


def tabular(x: str) -> str:
    lines = f"list_filter(string_split({x}, chr(10)), lambda q: {trimmed('q')} <> '')"
    digits = f"len(list_filter({lines}, lambda q: length(regexp_replace(q, '\\P{{Nd}}', '', 'g')) >= 3))"
    gaps = f"len(list_filter({lines}, lambda q: regexp_matches(q, '\\S {{2,}}\\S')))"
    return f"(len({lines}) >= 2 and ({digits} >= greatest(2.0, len({lines}) * 0.5) or {gaps} >= greatest(2.0, len({lines}) * 0.6)))"


# The period grammar, one notation a line: name, pattern with named parts, kind. ``S`` is a blank; a final part ``t`` says what must not follow.
_SPAN = r"(?P<y1>[0-9]{2,4})(?:S*[-/]S*(?P<y2>[0-9]{2,4}))?"
_PERIODS = (
    ("q_fy", rf"\bq(?P<n>[1-4])S*[:\-]?S*fyS*{_SPAN}\b", "quarter"),
    ("nq_fy", rf"\b(?P<n>[1-4])S*qS*fyS*{_SPAN}\b", "quarter"),
    ("q_of_fy", rf"\bq(?P<n>[1-4])S+ofS+(?:fy|fiscal(?:S+year)?)S*{_SPAN}\b", "quarter"),
    ("q_span", r"\bq(?P<n>[1-4])S*[:S]S*(?P<y1>[0-9]{4})S*[-/]S*(?P<y2>[0-9]{2,4})\b", "quarter"),
    ("h_fy", rf"\bh(?P<n>[12])S*[:\-]?S*(?:fyS*)?{_SPAN}\b", "half"),
    ("cal_q", r"\b(?:cy)?(?P<y1>[0-9]{4})S*[:\-]?S*q(?P<n>[1-4])\b", "cal_quarter"),
    ("q_cal", r"\bq(?P<n>[1-4])S*[,S]S*(?:cyS*)?(?P<y1>[0-9]{4})\b(?P<t>S*[-/]S*[0-9])?", "cal_quarter"),
    ("iso", r"(?:^|[^0-9])(?P<y1>(?:19|20)[0-9]{2})-(?P<mo>0[1-9]|1[0-2])-(?P<d1>0[1-9]|[12][0-9]|3[01])(?:[^0-9]|$)", "day"),
    ("fy_span", r"\bfyS*(?P<y1>[0-9]{2,4})S*[-/]S*(?P<y2>[0-9]{2,4})\b", "year"),
    ("fy", r"\b(?:fy|fiscal(?:S+year)?)S*(?P<y1>[0-9]{2,4})\b(?P<t>S*[-/]S*[0-9])?", "year"),
    ("span", r"\b(?P<y1>(?:19|20)[0-9]{2})S*[-/]S*(?P<y2>[0-9]{2})\b", "year"),
    ("cy", r"\b(?:cy|calendarS+year)S*(?P<y1>[0-9]{4})\b", "calendar"),
    ("as_on", r"\basS+(?:on|at|of)S+(?P<d1>[0-9]{1,2})?S*(?P<mo>[a-z]{3,9})\.?,?S*(?P<d2>[0-9]{1,2})?,?S*(?P<y1>[0-9]{4})\b", "day"),
    ("ended", r"\b(?:year|period)S+endedS+(?:[0-9]{1,2})?S*(?P<mo>[a-z]{3,9})\.?,?S*(?:[0-9]{1,2})?,?S*(?P<y1>[0-9]{4})\b", "ended"),
    ("month", r"\b(?P<mo>[a-z]{3,9})\.?S+(?P<y1>(?:19|20)[0-9]{2})\b", "month"),
    ("bare", r"\b(?P<y1>(?:19|20)[0-9]{2})\b", "calendar"),
)


def periods(source: str) -> str:
    """CTEs ending in ``read(raw, fy_end_month, p_kind, p_start, p_end, p_label, p_raw)`` over ``source(raw, fy_end_month)``: the first notation that names a window."""
    import re

    inner = BLANK[1:-1]
    digits = "translate(raw, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९০১২৩৪৫৬৭৮৯๐๑๒๓๔๕๖๗๘๙０１２３４５６７８９', '012345678901234567890123456789012345678901234567890123456789')"
    out = []
    for i, (_, pattern, kind) in enumerate(_PERIODS):
        names = re.findall(r"\?P<(\w+)>", pattern)
        # A mark of a set of blanks inside brackets, then blanks elsewhere.
        sql = pattern.replace("[:S]", f"[:{inner}]").replace("[,S]", f"[,{inner}]")
        sql = re.sub(r"S([*+])", lambda m: BLANK + m[1], sql)
        plain = re.sub(r"\?P<\w+>", "", sql)
        at = {n: names.index(n) + 2 for n in names}
        # All matches with all parts; the first whose forbidden tail is empty.
        parts = [f"regexp_extract_all(t, '(?i)({plain})', {k})" for k in range(1, len(names) + 2)]
        hits = f"list_zip({', '.join(parts)})"
        hit = f"list_filter({hits}, lambda x: coalesce(x[{at['t']}], '') = '')[1]" if "t" in at else f"{hits}[1]"
        g = lambda n: f"nullif(h[{at[n]}], '')" if n in at else "null"  # noqa: B023, E731
        out.append(
            f"select raw, fy_end_month, {i} i, '{kind}' k, h[1] whole, {g('n')}::int n, {g('y1')} y1, {g('y2')} y2, lower({g('mo')}) mo, coalesce({g('d1')}, {g('d2')}, '1')::int d from (select raw, fy_end_month, {hit} h from plain) where h is not null"
        )
    y = "case when length(y1) = 4 then y1::int when y1::int >= 70 then y1::int + 1900 else y1::int + 2000 end"
    # This engine's word boundaries know plain letters only, so letters of other scripts become underscores.
    letters = f"regexp_replace({digits}, '[\\p{{Lo}}\\p{{Lm}}\\x{{c0}}-\\x{{24f}}\\x{{370}}-\\x{{52f}}]', '_', 'g')"
    return f"""plain as (select raw, fy_end_month, {letters} t from {source}),
    hits as ({' union all '.join(out)}),
    years as (select *, {y} a, case when regexp_matches(mo, '^[0-9]+$') then mo::int else {MONTH_MAP}[mo] end m from hits),
    ended as (select *, case when y2 is null then a when length(y2) > 2 then case when length(y2) = 4 then y2::int when y2::int >= 70 then y2::int + 1900 else y2::int + 2000 end
        when a - a % 100 + y2::int < a then a - a % 100 + y2::int + 100 else a - a % 100 + y2::int end e from years),
    starts as (select *, case when k in ('quarter', 'half', 'year') then (make_date(e, fy_end_month, 1) - interval 11 month)::date when k = 'ended' then (make_date(a, m, 1) - interval 11 month)::date end f from ended where not (k in ('day', 'ended', 'month') and m is null)),
    windows as (select *, case k when 'quarter' then (f + to_months(3 * (n - 1)))::date when 'half' then (f + to_months(6 * (n - 1)))::date when 'cal_quarter' then make_date(a, 3 * n - 2, 1) when 'calendar' then make_date(a, 1, 1)
            when 'month' then make_date(a, m, 1) when 'day' then try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', a, m, least(d, day(last_day(make_date(a, m, 1))))) as date) else f end s,
        case k when 'quarter' then 3 when 'half' then 6 when 'cal_quarter' then 3 when 'month' then 1 when 'day' then 0 else 12 end n_months from starts),
    named as (select raw, fy_end_month, i, case k when 'quarter' then 'fiscal_quarter' when 'half' then 'fiscal_half' when 'cal_quarter' then 'calendar_quarter' when 'calendar' then 'calendar_year' when 'month' then 'month' when 'day' then 'instant' else 'fiscal_year' end p_kind,
        s p_start, case when n_months = 0 then s else last_day((s + to_months(n_months - 1))::date) end p_end,
        case k when 'quarter' then 'Q' || n || ' FY' || e when 'half' then 'H' || n || ' FY' || e when 'cal_quarter' then a || 'Q' || n when 'calendar' then 'CY' || a when 'month' then a || '-' || lpad(m::varchar, 2, '0') when 'day' then s::varchar when 'ended' then 'FY' || a else 'FY' || e end p_label,
        {trimmed('whole')} p_raw from windows where s is not null),
    read as (select q.raw, q.fy_end_month, coalesce(w.p_kind, 'unknown') p_kind, w.p_start, w.p_end, w.p_label, coalesce(w.p_raw, {trimmed('q.raw')}) p_raw
        from {source} q left join (select * from named qualify row_number() over (partition by raw, fy_end_month order by i) = 1) w on q.raw = w.raw and q.fy_end_month = w.fy_end_month where {trimmed('q.raw')} <> '')"""


def magnitude(x: str) -> str:
    """The scale a heading announces."""
    first = f"regexp_extract(lower({x}), '\\bin{BLANK}+(hundred|thousand|lakhs?|lacs?|millions?|crores?|billions?|trillions?)\\b', 1)"
    second = f"regexp_extract(lower({x}), '(?:₹|rs\\.?|inr|usd|\\$){BLANK}*(?:in{BLANK}*)?(thousand|lakhs?|lacs?|millions?|crores?|billions?)\\b', 1)"
    return f"{SCALE_MAP}[case when {first} <> '' then {first} else {second} end]"


#: A date in words on a cover: day before or after the month, year last.
DATE = f"(?i)(?:\\b([0-9]{{1,2}}){BLANK}*|\\b)({FULL_MONTHS}){BLANK}+([0-9]{{1,2}})?,?{BLANK}*((?:19|20)[0-9]{{2}})\\b"


def significant(x: str, digits: int = 4) -> str:
    """A number in so many significant digits without trailing zeros."""
    places = f"({digits - 1} - floor(log10(greatest(abs({x}), 1e-300)))::int)"
    power = f"pow(10.0::double, abs({places}))"
    rounded = f"(case when {x} = 0 then 0.0::double when {places} < 0 then round_even({x} / {power}, 0) * {power} else round_even({x} * {power}, 0) / {power} end)"
    return f"regexp_replace(regexp_replace(printf('%.10f', {rounded}), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"


def compact(x: str) -> str:
    return f"case when abs({x}) >= 1e12 then {significant(f'({x} / 1e12)')} || 'T' when abs({x}) >= 1e9 then {significant(f'({x} / 1e9)')} || 'B' when abs({x}) >= 1e6 then {significant(f'({x} / 1e6)')} || 'M' when abs({x}) >= 1e3 then {significant(f'({x} / 1e3)')} || 'K' else {significant(x)} end"


_B = r"[ \t\n\r\x{00a0}\x{2007}\x{2009}\x{202f}]"
_BG = r"[, \t\n\r\x{00a0}\x{2007}\x{2009}\x{202f}]"
_NUM = rf"(\(?){_B}*([-−+]?){_B}*((?:\d{{1,3}}(?:{_BG}\d{{2,3}})+(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+)){_B}*(\)?)"


def plausible(body: str) -> str:
    parts = f"string_split(split_part({body}, '.', 1), ',')"
    return (
        f"(not contains({body}, ',') or (length({parts}[1]) between 1 and 3 and (len(list_filter({parts}[2:], lambda g: length(g) <> 3)) = 0 "
        f"or (length({parts}[-1]) = 3 and len(list_filter({parts}[2:-2], lambda g: length(g) <> 2)) = 0))))"
    )


def numbers(source: str) -> str:
    """CTEs ending in ``numbers(source.*, hit, v, before, tail, hedged)``: the first plausible number of ``raw``."""
    return f"""hit_numbers as (select *, list_filter(list_zip(regexp_extract_all(raw, '{_NUM}', 0), regexp_extract_all(raw, '{_NUM}', 3)), lambda x: {plausible("x[2]")})[1] as h from {source}),
        sized as (select *, h[1] as hit, try_cast(regexp_replace(h[2], '{_BG}', '', 'g') as double) as size, left(raw, strpos(raw, h[1]) - 1) as before, substr(raw, strpos(raw, h[1]) + length(h[1])) as tail from hit_numbers),
        numbers as (select *, case when regexp_matches(hit, '^\\(') and regexp_matches(hit, '\\)$') then -abs(size) when regexp_matches(hit, '^\\(?[\\s\\x{{00a0}}]*[-−]') then -size else size end as v,
            regexp_matches(lower(right(before, 24)), '\\b(?:about|approximately|approx|around|nearly|roughly|circa|over|more than|almost|close to|in excess of)\\b|~') as hedged from sized)"""


def currency(x: str, which: int) -> str:
    """Code of the first (1) or last (-1) currency marker; letters count as whole words only."""
    # Marks are doubled first, because this engine's patterns cannot look behind.
    apart = f"(' ' || regexp_replace(lower({x}), '([^a-z])', '\\1\\1', 'g') || ' ')"
    hit = f"regexp_extract_all({apart}, '(us\\$|[₹$€£¥]|[^a-z](?:rs|inr|usd|eur|gbp|jpy|aed|sgd|cny|rmb)[^a-z])', 1)[{which}]"
    return f"{CURRENCY_MAP}[case when regexp_matches({hit}, '[a-z]') and not contains({hit}, '$') then regexp_replace({hit}, '[^a-z]', '', 'g') else {hit} end]"


def percent(x: str) -> str:
    near = f"ltrim(lower(left({x}, 24)), ' ')"
    return f"(case when regexp_matches({near}, '^(?:%|per\\s*cent|percent|percentage point)') then 'percent' when regexp_matches({near}, '^(?:bps\\b|basis points?)') then 'basis_points' end)"


def _singular(x: str) -> str:
    return f"(case when length({x}) > 4 and {x} like '%ies' then regexp_replace({x}, 'ies$', 'y') when regexp_matches({x}, '(?:ses|xes)$') then regexp_replace({x}, 'es$', '') when regexp_matches({x}, '[^s]s$') then regexp_replace({x}, 's$', '') else {x} end)"


def quantities(source: str) -> str:
    """CTEs ending in ``quantities(source.*, v, kind, canonical_unit, canonical_value, magnitude, approximate)`` over ``source(raw, unit_hint, magnitude_hint)``."""
    scaled = f"regexp_extract(tail, '(?i)^({_B}*(?:{SCALE_WORDS}))(?:[^A-Za-z]|$)', 1)"
    return f"""{numbers(source)},
        worded as (select *, lower(regexp_replace({scaled}, '{_B}', '', 'g')) word, case when {scaled} <> '' then regexp_replace(substr(tail, length({scaled}) + 1), '^\\.', '') else tail end as rest from numbers),
        nouns as (select *, coalesce({percent('tail')}, {percent('rest')}) pct, coalesce({currency('right(before, 40)', -1)}, {currency("coalesce(unit_hint, '')", 1)}) cur,
            {_singular("lower(regexp_extract(rest, '^[\\s-]*([A-Za-z]+)', 1))")} near, {_singular("lower(regexp_extract(rest, '^[\\s-]*[A-Za-z]+\\.?\\s+([A-Za-z]+)', 1))")} noun2 from worded),
        kinds as (select *, case when {NOUNS}[near] is not null then near else noun2 end noun from nouns),
        judged as (select *, case when v is null then null when pct is not null then 'percent' when cur is not null then 'currency' when noun in ({MASS}) then 'count' when {NOUNS}[noun] is not null then 'duration'
            when regexp_matches(lower(coalesce(unit_hint, '')), '%|per cent|percent|pp|bps|basis points') then 'percent' else 'other' end kind,
            case when v is not null then coalesce({SCALE_MAP}[word], nullif(magnitude_hint, 0), 1.0::double) end magnitude, case when v is not null then hedged end approximate from kinds),
        quantities as (select *exclude (h), case kind when 'percent' then 'percent' when 'currency' then cur when 'count' then 'kg' when 'duration' then 'days' end canonical_unit,
            case when kind = 'other' then null when pct = 'basis_points' then v * 0.01::double else v * magnitude * case when kind in ('count', 'duration') then {NOUNS}[noun] else 1.0::double end end canonical_value from judged)"""


def entity_keys(source: str) -> str:
    """CTEs ending in ``entity_keys(entity, key)`` over ``source(entity)``."""
    return rf"""split_names as (select entity, list_filter(regexp_split_to_array(regexp_replace(translate(lower(strip_accents(entity)), '‘’“”', repeat(chr(39), 4)), '[^\p{{L}}\p{{M}}\p{{N}}_\s&'']', ' ', 'g'), '[\s\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{3000}}]+'), lambda x: x <> '') ws from {source}),
        bare_front as (select entity, ws[coalesce(list_position(list_transform(ws, lambda x: x in ({HONORIFICS})), false), len(ws) + 1):] ws from split_names),
        bare_back as (select entity, ws[:len(ws) + 1 - coalesce(list_position(list_reverse(list_transform(ws, lambda x: x in ({SUFFIXES}))), false), len(ws) + 1)] ws from bare_front),
        bare as (select entity, ws, list_filter(ws, lambda x: x not in ({ARTICLES})) kept from bare_back),
        entity_keys as (select entity, array_to_string(case when len(kept) > 0 then kept else ws end, ' ') as key from bare)"""


#: Evidence with its trimmed quote and how it stands on its page, as it is or with other blanks.
GROUNDED = f"""select e.evidence_id, e.fact_id, e.doc_id, e.page, nullif({trimmed('e.quote')}, '') q,
        case when length({trimmed('e.quote')}) >= 8 then case when contains(p.text, {trimmed('e.quote')}) then 'exact' when contains(regexp_replace(p.text, '{BLANK}+', ' ', 'g'), regexp_replace({trimmed('e.quote')}, '{BLANK}+', ' ', 'g')) then 'whitespace' end end how
    from evidence e left join doc_pages p on e.doc_id = p.doc_id and e.page = p.page"""


def clean(x: str) -> str:
    return f"regexp_replace(regexp_replace(translate(replace(replace({x}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), '‘’“”' || chr(173) || chr(8203), chr(39) || chr(39) || chr(34) || chr(34)), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"


def letters(x: str) -> str:
    return f"length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g'))"


def generic(x: str) -> str:
    """Whether a title says nothing."""
    plain = f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z'' ]', ' ', 'g'), ' +', ' ', 'g'), ' ')"
    # Furniture of cover pages.
    listed = "'contents', 'table of contents', 'what''s inside', 'whats inside', 'index', 'annual report', 'introduction', 'overview', 'disclaimer', 'notice', 'about this report', 'highlights', 'appendix', 'glossary', 'abbreviations'"
    return f"({plain} in ({listed}) or length({plain}) < 6)"
