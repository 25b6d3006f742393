"""The word lists, patterns and constants that results depend on."""

# Function words that carry no content.
STOPWORDS = """
a about above after again all also am an and any are as at be because been before being below between both but by
can did do does doing down during each few for from further had has have having he her here hers him his how i if
in into is it its itself just me more most my no nor not now of off on once only or other our out over own
same she should so some such than that the their them then there these they this those through to too under until up
very was we were what when where which while who whom why will with would you your
""".split()

# Patterns of words, numbers, markers and terms.
WORD = r"[A-Za-z0-9_]+(?:['\-][A-Za-z0-9]+)*"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z(\[])"
ACRONYM = r"\b[A-Z][A-Z0-9]{1,}(?:-[A-Z0-9]+)*\b"
IDENTIFIER = r"\b(?:[A-Za-z]+[-_]?\d+[A-Za-z0-9\-_.]*|[A-Za-z]+\d[A-Za-z0-9]*)\b"
CAMEL_CASE = r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b"
NUMBER = r"\b\d+(?:[.,]\d+)?%?\b"
MARKER = r"\[(\d{1,2})\]"

# Signal words of the query analyzer, matched as substrings.
STRONG_VISUAL = ["chart", "charts", "plot", "plots", "diagram", "diagrams", "screenshot", "heatmap", "scatter", "histogram", "bar graph", "line graph", "pie chart", "architecture diagram", "flowchart", "visualization", "visualisation"]
WEAK_VISUAL = ["figure", "figures", "fig", "image", "images", "picture", "pictures", "graph", "visual", "axis", "axes", "curve", "curves", "legend", "illustrated", "depicted", "shown in", "pictured"]
TABULAR = ["table", "tables", "row", "rows", "column", "columns", "cell", "spreadsheet", "csv", "tabulated", "dataset values", "numbers in"]
RELATIONSHIP = ["relationship", "related", "relate", "relates", "connection", "connected", "connect", "between", "link", "linked", "depends", "dependency", "interaction", "influence", "affects", "impact", "association", "associated", "versus", "vs", "built on", "based on", "derived from", "uses", "used by", "cites", "extends"]
COMPARISON = ["compare", "comparison", "versus", "vs", "difference", "differences", "differ", "better", "worse", "outperform", "outperforms", "faster", "slower", "trade-off", "tradeoff", "advantages", "disadvantages", "pros", "cons", "instead of"]
MULTI_HOP = ["and then", "which in turn", "that also", "both", "all of", "each of", "across", "combined", "together with", "as well as", "in addition to", "followed by", "why does", "how does", "what causes", "leads to", "results in", "consequently"]
SUMMARY = ["summarize", "summary", "summarise", "overview", "outline", "key points", "main findings", "tl;dr", "brief", "recap", "gist"]
PROCEDURAL = ["how to", "how do i", "steps", "procedure", "process", "install", "configure", "setup", "set up", "implement", "workflow", "pipeline"]
DEFINITION = ["what is", "what are", "define", "definition", "meaning of", "stands for"]
ANALYSIS = ["why", "analyze", "analyse", "evaluate", "assess", "critique", "implication", "implications", "significance", "reasoning", "justify", "explain why", "limitations"]
CROSS_DOCUMENT = ["papers", "documents", "sources", "studies", "across", "each paper", "all papers", "every document", "both papers", "literature", "compared across"]
VERIFICATION = ["exact", "exactly", "precise", "precisely", "cite", "citation", "source", "prove", "evidence", "verify", "confirm", "accurate", "correct", "actual", "official", "statistic", "percentage", "number"]
VALUE = ["score", "scores", "value", "values", "result", "results", "rate", "accuracy", "precision", "recall", "latency", "throughput", "size", "count", "how many", "how much", "number of", "percentage", "metric", "performance"]

# Patterns of the query analyzer, without lookaround.
FIGURE_REFERENCE = r"(?i)\b(?:fig(?:ure)?s?\.?\s*\d+[a-z]?)\b"
NOT_VISUAL = r"(?i)\b(?:revenue|sales|financial|profit|cost|budget|headline|key|the|these|those)\s+figures\b|\bfigures?\s+(?:for|from)\s+\d{4}\b|\bgraph\s+(?:database|store|traversal|rag|neural network)\b"
SHOWING = r"\b(show|shows|shown|display|displays|depict|depicts|illustrate|illustrates|look|see)\b"
TABLE_REFERENCE = r"(?i)\btable\s*\d+"
INTERROGATIVE = r"(?i)\b(?:what|which|how|why|when|where|who|whose)\b"
CHAINED = r"(?i)[,;]?\s*\b(?:and|then|also|plus|as well as)\s+(?:what|which|how|why|when|where|who)\b"
CONJUNCTION = r"\b(?:and|or|as well as|plus|also)\b"
NUMERIC = r"\b\d+(?:\.\d+)?%?\b"
FOLLOW_UP = r"^(?:and|but|what about|how about|also)\b"

# Of claim extraction.
ABSTENTION = "insufficient evidence found in the indexed knowledge base"
META_PREFIXES = ["based on the", "according to the provided", "the evidence", "in summary", "to summarize", "overall,", "however,", "note that", "it is worth", "the retrieved", "the documents", "here is", "here's"]
COMPARATIVE = ["more than", "less than", "better", "worse", "outperform", "compared"]
CAUSAL = ["because", "therefore", "causes", "leads to", "due to"]
DEFINING = [" is a ", " is the ", " refers to", " means "]
HEDGES = ["might", "may be", "could be", "possibly", "perhaps", "it seems", "appears to"]

# Weights of the confidence score.
CONFIDENCE = {"claim_support": 0.34, "retrieval_quality": 0.22, "citation_coverage": 0.18, "citation_accuracy": 0.10, "evidence_agreement": 0.08, "strategy_consensus": 0.08}
