"""English stop words."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column

# The published English stop-word list of a common text toolkit (179 words).
TOOLKIT = tuple("""
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don don't should should've
now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split())

# The published plain English list (174 words).
PLAIN = tuple("""
a about above after again against all am an and any are aren't as at be because been before being
below between both but by can't cannot could couldn't did didn't do does doesn't doing don't down
during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's her
here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's
its itself let's me more most mustn't my myself no nor not of off on once only or other ought our
ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than
that that's the their theirs them themselves then there there's these they they'd they'll they're
they've this those through to too under until up very was wasn't we we'd we'll we're we've were
weren't what what's when when's where where's which while who who's whom why why's with won't would
wouldn't you you'd you'll you're you've your yours yourself yourselves
""".split())

# The words the word-cloud list has beyond PLAIN.
CLOUD_EXTRA = tuple("""
also can com else ever get hence however http just k like otherwise r shall since therefore www
""".split())

CLOUD = PLAIN + CLOUD_EXTRA


def merged() -> list[str]:
    """Both English lists without repeats, in a stable order."""
    return sorted(set(TOOLKIT) | set(PLAIN))


def is_stop_word(word: Column, stop_words: Iterable[str]) -> Column:
    """Membership in a fixed list of at most a few hundred literals: a hash lookup, no join."""
    return word.isin(list(stop_words))
