"""The English stop list of the search analyser: common function words of three letters or more
(shorter words are never indexed), the contraction n't, and what an escaped ampersand leaves."""

_FUNCTION_WORDS = """
about above after again against all and any are because been before being below between both but can
did does doing don down during each few for from further had has have having her here hers herself him
himself his how into its itself just more most myself nor not now off once only other our ours ourselves
out over own same she should some such than that the their theirs them themselves then there these they
this those through too under until very was were what when where which while who whom why will with you
your yours yourself yourselves
"""

STOPWORDS: tuple[str, ...] = (*_FUNCTION_WORDS.split(), "n't", "amp")
