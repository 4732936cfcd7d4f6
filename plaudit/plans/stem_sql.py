"""English stemming as SQL over a table ``vocabulary(term)``: the independent check of the UDF.

Terms come from the word tokenizer, so they hold no apostrophes and the apostrophe step falls away.
"""

from __future__ import annotations


def _suffix_rules(word: str, region: str, rules: list[tuple[str, str]]) -> str:
    """CASE arms, longest suffix first: replace the suffix if it lies in the region, else keep."""
    arms = []
    for suffix, new in rules:
        at = f"length({word}) - {len(suffix)}"
        arms.append(f"WHEN ends_with({word}, '{suffix}') THEN "
                    f"CASE WHEN {at} >= {region} THEN concat(left({word}, {at}), '{new}') "
                    f"ELSE {word} END")
    return "\n    ".join(arms)


STEP_2 = [
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"),
    ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"),
    ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"), ("fulli", "ful"),
    ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"), ("anci", "ance"),
    ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"),
]
STEP_3 = [
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"),
    ("ical", "ic"), ("ness", ""), ("ful", ""),
]
STEP_4 = [(s, "") for s in (
    "ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ism", "iti", "ive",
    "ize", "ous", "al", "er", "ic")]

REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
SHORT = ("(regexp_matches({0}, '(^|[^aeiouy])[aeiouy][^aeiouywxY]$') "
         "OR regexp_matches({0}, '^[aeiouy][^aeiouy]$'))")

STEMS = f"""
marked AS (
  SELECT term, regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w
  FROM vocabulary),
first_region AS (
  SELECT term, w, CASE
    WHEN starts_with(w, 'gener') THEN 5 WHEN starts_with(w, 'commun') THEN 6
    WHEN starts_with(w, 'arsen') THEN 5
    WHEN regexp_matches(w, '{REGION}') THEN length(regexp_extract(w, '{REGION}'))
    ELSE length(w) END AS r1
  FROM marked),
regions AS (
  SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), '{REGION}')
                 THEN r1 + length(regexp_extract(substr(w, r1 + 1), '{REGION}'))
                 ELSE length(w) END AS r2
  FROM first_region),
plurals AS (
  SELECT term, r1, r2, CASE
    WHEN ends_with(w, 'sses') THEN left(w, length(w) - 2)
    WHEN ends_with(w, 'ied') OR ends_with(w, 'ies')
      THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
    WHEN ends_with(w, 'us') OR ends_with(w, 'ss') THEN w
    WHEN ends_with(w, 's') AND regexp_matches(left(w, length(w) - 2), '[aeiouy]')
      THEN left(w, length(w) - 1)
    ELSE w END AS w
  FROM regions),
endings AS (
  SELECT *, w IN ('inning', 'outing', 'canning', 'herring', 'earring', 'proceed', 'exceed',
                  'succeed') AS kept,
    CASE WHEN ends_with(w, 'eedly') OR ends_with(w, 'ingly') THEN 5
         WHEN ends_with(w, 'edly') THEN 4
         WHEN ends_with(w, 'eed') OR ends_with(w, 'ing') THEN 3
         WHEN ends_with(w, 'ed') THEN 2 ELSE 0 END AS size
  FROM plurals),
bases AS (
  SELECT *, left(w, length(w) - size) AS base,
         ends_with(w, 'eed') OR ends_with(w, 'eedly') AS eed FROM endings),
past AS (
  SELECT term, r1, r2, kept, CASE
    WHEN kept OR size = 0 THEN w
    WHEN eed THEN CASE WHEN length(base) >= r1 THEN concat(base, 'ee') ELSE w END
    WHEN NOT regexp_matches(base, '[aeiouy]') THEN w
    WHEN regexp_matches(base, '(at|bl|iz)$') THEN concat(base, 'e')
    WHEN regexp_matches(base, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(base, length(base) - 1)
    WHEN r1 >= length(base) AND {SHORT.format('base')} THEN concat(base, 'e')
    ELSE base END AS w
  FROM bases),
ys AS (
  SELECT term, r1, r2, kept, CASE
    WHEN NOT kept AND length(w) > 2 AND regexp_matches(w, '[^aeiouy][yY]$')
    THEN concat(left(w, length(w) - 1), 'i') ELSE w END AS w
  FROM past),
step2 AS (
  SELECT term, r1, r2, kept, CASE WHEN kept THEN w
    {_suffix_rules('w', 'r1', STEP_2)}
    WHEN ends_with(w, 'ogi') THEN CASE WHEN ends_with(w, 'logi') AND length(w) - 3 >= r1
      THEN left(w, length(w) - 1) ELSE w END
    WHEN ends_with(w, 'li') AND length(w) - 2 >= r1 AND regexp_matches(w, '[cdeghkmnrt]li$')
      THEN left(w, length(w) - 2)
    ELSE w END AS w
  FROM ys),
step3 AS (
  SELECT term, r1, r2, kept, CASE WHEN kept THEN w
    {_suffix_rules('w', 'r1', STEP_3)}
    WHEN ends_with(w, 'ative') AND length(w) - 5 >= r2 THEN left(w, length(w) - 5)
    ELSE w END AS w
  FROM step2),
step4 AS (
  SELECT term, r1, r2, kept, CASE WHEN kept THEN w
    {_suffix_rules('w', 'r2', STEP_4)}
    WHEN length(w) - 3 >= r2 AND regexp_matches(w, '[st]ion$') THEN left(w, length(w) - 3)
    ELSE w END AS w
  FROM step3),
step5 AS (
  SELECT term, CASE
    WHEN kept THEN w
    WHEN ends_with(w, 'e') AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1
         AND NOT {SHORT.format('left(w, length(w) - 1)')})) THEN left(w, length(w) - 1)
    WHEN ends_with(w, 'll') AND length(w) - 1 >= r2 THEN left(w, length(w) - 1)
    ELSE w END AS w
  FROM step4),
stems AS (
  SELECT term, CASE
    WHEN length(term) <= 2 THEN term
    WHEN term IN ('sky', 'news', 'howe', 'atlas', 'cosmos', 'bias', 'andes') THEN term
    WHEN term = 'skis' THEN 'ski' WHEN term = 'skies' THEN 'sky' WHEN term = 'dying' THEN 'die'
    WHEN term = 'lying' THEN 'lie' WHEN term = 'tying' THEN 'tie' WHEN term = 'idly' THEN 'idl'
    WHEN term = 'gently' THEN 'gentl' WHEN term = 'ugly' THEN 'ugli'
    WHEN term = 'early' THEN 'earli' WHEN term = 'only' THEN 'onli'
    WHEN term = 'singly' THEN 'singl'
    ELSE replace(w, 'Y', 'y') END AS stem
  FROM step5)"""
