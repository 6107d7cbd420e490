"""Patterns, word lists and tables that the text functions are defined by."""

BINARY_QUESTION = [
    r"^(is|are|was|were|does|do|did|has|have|had|can|could|will|would|should)\s+.+\?$",
    r"^(true|false)\s",
    r"^(yes|no)\s",
    r"\b(true or false)\b",
    r"\b(yes or no)\b",
]
EXPLANATION = [
    r"^(explain|describe|how does|how do|why does|why do|what is the mechanism|what trend|how can you|how would you)",
    r"\b(explain|describe|discuss|elaborate)\b",
    r"\bwhat trend\b",
    r"\bhow (?:does|do|can|would)\b",
]
TRICK_ANSWERS = ["none", "cannot be determined", "n/a", "not applicable", "no answer", "unclear", "none of the above"]
RESTRICTS_OPTIONS = [r"out of (?:the )?\d+", r"from (?:the )?(?:following|these|below)", r"(?:which|among) (?:of )?(?:the )?(?:following|these|below)"]
MATH_HEAVY = [r"\b(?:multiply|divide|subtract|add)\b", r"\b(?:calculate|compute|solve)\b", r"\b(?:sum|product|quotient|difference)\s+of\s+", r"\b\d+\s*[\*\/×÷]\s*\d+\b"]
TEXT_HEAVY = [r"^what does (?:this|the|it) say", r"^what is written", r"^what (?:does|is) the (?:text|caption|quote|title|heading|label) say"]
LONG_WINDED = [r"\bthe (?:one|item) (?:that|who) (?:is|has|contains) .*? and (?:is|has|contains)", r"^(?:the|a|an)\s+\w+\s+(?:that|who|which)\s+\w+\s+\w+"]
JARGON = [r"\bhybridization\b", r"\bsigma bond\b", r"\bpi bond\b", r"\blumo\b", r"\bhomo\b", r"\bsp[23]\b", r"\bebitda\b", r"\bwacc\b", r"\bdcf\b", r"\bp-value\b", r"\bchi.?square\b"]
REASONING = [
    r"\b(highest|lowest|most|least|fewest|greatest)\b.*\b(highest|lowest|most|least|fewest|greatest)\b",
    r"\b(also|and|while|whereas|compared|between|versus|vs)\b",
    r"\b(rank|order|sort|compare|relative|ratio|factor)\b",
    r"\b(first|second|third|top|bottom)\b.*\b(first|second|third|top|bottom)\b",
    r"\b(sum|total|average|difference|ratio|factor|proportion)\b",
    r"\b(larger|smaller|greater|less|fewer)\b.{0,40}\bthan\b",
    r"\b(magnitude)\b",
]
NOISE_CONDITION = [r"\bbetween\s+[\d.]+\s*(?:nm|mm|cm|m|kg|lb|s|sec|min|hr|h|°[cfk])\s+and\s+[\d.]+", r"\bover\s+all\s+wavelengths\b", r"\bacross\s+all\b"]
EXTREME_SEEKING = [
    r"\b(highest|lowest|largest|smallest|most|least|fewest|greatest)\b",
    r"\b(maximum|minimum|max|min)\b",
    r"\b(leftmost|rightmost|topmost|bottommost)\b",
    r"\b(best|worst|strongest|weakest)\b",
]
THRESHOLD = [r"\b(fewer|less|more|greater|above|below|over|under|exactly|closest to|nearest to)\s+(?:than\s+)?\d", r"\b(between|within|around)\s+\d", r"\b(?:less|more)\s+than\s+\d"]
MULTI_PANEL = [r"\bpanel\s*\([a-z]\)", r"\bfigure\s*\d", r"\b(a)\b.*\b(b)\b", r"\bleft\b.*\bright\b", r"\btop\b.*\bbottom\b"]
CHART_FURNITURE = [
    r"\b(?:tick|axis|colorbar|legend)\s+(?:labels?|marks?|ticks?|numbers?)\b",
    r"\b(?:count|how\s+many)\s+(?:the\s+)?(?:tick|axis|colorbar|legend)\b",
    r"\b(?:labeled|numerical)\s+(?:tick|values?|labels?|numbers?)\b.*\b(?:axis|colorbar|legend|tick)\b",
]
CHART_DATA = [
    r"\b(?:peak|maximum|minimum|max|min|valley|trough)\b",
    r"\b(?:x|y|z)\s*(?:-\s*axis|axis)?\s*(?:value|coordinate|position|at)\b",
    r"\b(?:surface|curve|bar|line|series|column|histogram)\b",
    r"\b(?:panel|figure)\s*[ab]\b.*\b(?:panel|figure)\s*[ab]\b",
    r"\b(?:ratio|difference|sum|total|average|mean)\b.*\b(?:panel|figure|between|across)\b",
    r"\b(?:exceed|above|below|greater|less|threshold|over|under)\s+(?:than\s+)?-?\d",
    r"\b(?:at\s+(?:the\s+)?(?:x|y|t)\s*=\s*-?\d)",
    r"\b(?:steepest|flattest|highest|lowest)\s+(?:point|value|region|peak)\b",
    r"\b(?:gradient|slope|derivative)\b",
]
GENERIC_COUNT = [
    r"^how\s+many\s+[\w\s]+\s+(?:are|appear|exist|visible)\s+(?:in\s+)?(?:the\s+)?(?:image|figure|chart|diagram|plot)\s*[\?\.]?$",
    r"^count\s+(?:the\s+)?(?:total\s+)?(?:number\s+of\s+)?[\w\s]+(?:in|across)\s+(?:the\s+)?(?:image|figure|chart|diagram)\s*[\?\.]?$",
]
ANSWER_IN_QUESTION = [
    r"\b\w+\s+(?:covers|ranges|spans|goes)\s+(?:\w+\s+)?(?:from\s+)?-?\d+(?:\.\d+)?\s*(?:to|-)\s*-?\d+(?:\.\d+)?\b.*\b\w+\s+(?:covers|ranges|spans|goes)\s+(?:\w+\s+)?(?:from\s+)?-?\d+(?:\.\d+)?\s*(?:to|-)\s*-?\d+(?:\.\d+)?",
    r"\baxis\s+\w+\s+(?:from\s+)?-?\d+(?:\.\d+)?\s*(?:to|-)\s*-?\d+(?:\.\d+)?\s*(?:and|,).{0,40}(?:from\s+)?-?\d+(?:\.\d+)?\s*(?:to|-)\s*-?\d+(?:\.\d+)?",
    r"\b(?:values?|scores?|numbers?)\s+(?:are|of|=)\s+-?\d+(?:\.\d+)?\s*(?:,|and|;)\s*-?\d+(?:\.\d+)?\s*(?:,|and|;)\s*-?\d+(?:\.\d+)?",
    r"\b\w+\s+is\s+-?\d+(?:\.\d+)?\s*(?:,|;|and)\s*\w+\s+is\s+-?\d+(?:\.\d+)?\s*(?:,|;|and)\s*\w+\s+is\s+-?\d+(?:\.\d+)?",
]
WATERMARKS = ["shutterstock", "getty", "©", "all rights reserved", "istock", "alamy", "watermark", "stock photo"]
VISUAL_WORDS = [
    "chart", "graph", "figure", "image", "diagram", "plot", "table", "panel", "bar", "line", "pie", "color", "shape", "object", "left", "right", "top", "bottom", "above", "below", "next to", "between", "behind", "front", "show", "display",
    "axis", "label", "legend", "title", "y-axis", "x-axis", "grid", "row", "column", "cell", "tile", "circle", "square", "highlighted", "marked", "circled", "indicated", "pointed",
]
MANUFACTURED = [
    r"^count\s+.*?\s+and\s+.*?\s+then\s+(?:count|add|sum|give)",
    r"^how\s+many\s+.*?\s+and\s+how\s+many\s+",
    r"^count\s+.*?\s+then\s+(?:add|sum|multiply|give)",
    r"rank(?:ed)?\s+by\s+(?:the\s+)?number(?:\s+of)?",
    r"^count\s+.*?\s+and\s+.*?\s+then\s+(?:multiply|product|times)",
    r"^count\s+.*?\s+(?:multiply|product|times)\s+.*?\s+(?:by|with)",
    r"^how\s+many\s+.*?\s+(?:multiply|product|times)\s+.*?\s+(?:by|with)",
]
BINARY_CHOICE = [
    r"\bhigher\s+or\s+lower\b",
    r"\blower\s+or\s+higher\b",
    r"\bgreater\s+or\s+(?:less|lesser)\b",
    r"\b(?:lesser|less)\s+or\s+greater\b",
    r"\bincreas(?:e|ing|es)\s+or\s+decreas(?:e|ing|es)\b",
    r"\bdecreas(?:e|ing|es)\s+or\s+increas(?:e|ing|es)\b",
    r"\bupward\s+or\s+downward\b",
    r"\bdownward\s+or\s+upward\b",
    r"\b(?:does|is)\s+.*?\s+(up|down)\s+or\s+(up|down)\b",
]
BINARY_ANSWERS = [
    "higher", "lower", "greater", "less", "increases", "increasing", "increase", "decreases", "decreasing", "decrease", "upward", "downward", "up", "down", "before", "after", "left", "right", "yes", "no", "true", "false",
]
INLINE_CHOICES = [
    r"\b(?:is|are|does|do|has|have|was|were|did|can|could|will|would|should)\s+.+?\s+or\s+.+?\?",
    r"\b(?:choose|select|pick)\s+(?:between|from)\s+.+?\s+or\s+",
    r"\b(?:is\s+it|are\s+they)\s+.+?\s+or\s+.+?\?",
    r"\b(?:which|what)\s+.+?:\s*.+?\s+or\s+.+?",
]
MATCHMAKING = [
    r"which\s+(?:single\s+)?panel\s+(?:meets|has|shows|satisfies|contains)",
    r"which\s+(?:component|node|gate|element)\s+(?:has|meets|satisfies)",
    r"identify\s+the\s+(?:panel|component|node|gate|element)\s+that",
    r"which\s+(?:one|single)\s+(?:has|meets|shows|satisfies|contains)",
    r"what\s+is\s+the\s+name\s+of\s+",
    r"what\s+is\s+the\s+value\s+of\s+",
]
COMPARATIVE = [r"\b(higher|lower|larger|greater|steeper|flatter|faster|slower|more|most|fewer|less)\b"]
SINGLE_LOOKUP = [r"^(what|which)\s+(is|are|was|were)\s+the?\s+\w+\s+of\s+", r"^(what|which)\s+(is|are)\s+the?\s+name\s+of\s+", r"^(what|which)\s+(is|are)\s+the?\s+value\s+of\s+"]
TWO_PANELS = [r"panel\s*\([a-z]\).*panel\s*\([a-z]\)"]
COMPLEX_WORDS = ["compare", "difference", "ratio", "relative", "versus", "vs", "sum", "total", "average", "product", "multiply", "add", "rank", "order", "sort", "highest", "lowest", "most", "least"]
MATH_OPERATION = [r"\b(ratio|factor)\b", r"\b(what\s+is\s+the\s+sum|sum\s+of)\b", r"\b(what\s+is\s+the\s+difference|difference\s+between)\b", r"\b(what\s+is\s+the\s+product|product\s+of)\b"]
INLINE_DATA = [r"\b\w+\s+(?:covers|ranges|spans|goes)\s+(?:\w+\s+)?(?:from\s+)?-?\d", r"\baxis\s+\w+\s+(?:from\s+)?-?\d", r"\b(?:values?|scores?)\s+(?:are|of)\s+-?\d"]
EXTREME_ANSWERS = ["highest", "lowest", "largest", "smallest", "maximum", "minimum", "most", "least", "best", "worst", "first", "last", "top", "bottom"]
GUESSABLE_ANSWERS = ["yes", "no", "true", "false", "none", "all", "both", "neither"]
SUBJECTIVE_ANSWERS = ["varies", "maybe", "it depends", "unclear"]
ARITHMETIC = [r"\b(?:product|sum|difference|quotient|multipl(?:y|ied)|add(?:ed)?|subtract(?:ed)?|divide?)\b"]
CALCULATION_WORDS = ["change", "increase", "decrease", "difference", "ratio", "percentage", "rank", "sum", "total", "average", "how many more", "how many less", "percentage point", "drop", "rise", "exceed", "cross"]
WHEN_WORDS = r"\bwhen\s+(?:ranked|sorted|compared|assigned|given|viewed|ordered|measured|numbered|evaluated|listed|arranged|placed|grouped|labeled|set)\b"
TWO_QUESTIONS = [r"\b(?:which|what|how|where|when)\b.*?\band\b.*?\b(?:which|what|how|where|when)\b"]

#: (class, pattern), first match wins, case ignored.
STRATEGIES = [
    ("percentage_change", r"percent(age)? (point )?(increase|decrease|change)|increas.+by .+percent"),
    ("rank", r"\brank|position|drops|rises|how many positions"),
    ("cross_panel_sum_diff", r"\bsum|total|difference between|exceeds|difference of|averag"),
    ("spatial", r"\b(above|below|left|right|top|bottom|corner|between)\b"),
    ("comparison", r"\bwhich (is|panel|one)|higher|larger|steeper|greater|largest|smallest"),
    ("counting", r"\bhow many|count|\bnumber of\b"),
    ("single_lookup", r"^what is the .+ (of|in) "),
]
#: The classes of the coverage matrix: (class, any of these, and any of these).
COVERAGE_STRATEGIES = [
    ("counting", ["how many", "count", "number of"], None),
    ("comparison", ["which panel", "which series", "which component"], ["higher", "lower", "greater", "larger", "more", "less"]),
    ("single_lookup", ["which panel", "which series", "which component"], None),
    ("rank", ["rank", "position", "order", "drops", "rises"], None),
    ("cross_panel_sum_diff", ["sum", "difference", "total", "combined"], None),
    ("spatial", ["closest", "farthest", "spatial", "left", "right", "above", "below"], None),
    ("percentage_change", ["percent", "ratio", "proportion", "increase", "decrease"], None),
]
#: (part of a model's name, USD for 1000 tokens in, out), first match wins.
TOKEN_COSTS = [
    ("minimax-m3", 0.15, 0.60), ("minimax-m2", 0.15, 0.60), ("gpt-5", 2.50, 10.00), ("gpt-5-codex", 2.50, 10.00), ("claude-sonnet-4", 3.00, 15.00),
    ("claude-opus-4", 15.00, 75.00), ("gemini-2.5-pro", 1.25, 5.00), ("gemini-2.5-flash", 0.075, 0.30), ("deepseek-v3", 0.27, 1.10), ("mimo-v2.5", 0.15, 0.60),
]
DEFAULT_COST = (0.15, 0.60)

INJECTION = [
    r"ignore\s+(all\s+)?(previous|above|prior)\s+(instructions|prompts|directions)",
    r"forget\s+(everything|all|your)\s+(previous|prior|training)",
    r"you\s+(are\s+)?(now|must\s+act\s+as)\s+(\w+\s+){0,5}(free|unconstrained|unrestricted|dan)",
    r"system\s+prompt",
    r"print\s+(your|the)\s+(prompt|instructions|system)",
    r"output\s+(your|the)\s+(prompt|instructions|system)",
    r"reveal\s+(your|the)\s+(prompt|instructions|system)",
    r"how\s+(can\s+)?(i\s+)?(bypass|override|break)\s+(the\s+)?(rules|restrictions|guardrails)",
    r"role\s*:\s*system",
]
SENSITIVE = [
    r"opencode_api_key|openai_api_key|anthropic_api_key|gemini_api_key",
    r"(api[_-]?key|secret[_-]?key|password|auth[_-]?token)\s*[:=]\s*\S{8,}",
    r"\b[a-z0-9_-]{20,}\b",
]
PII = [
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("phone", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("card", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b"),
]
TOXIC_WORDS = r"\b(hate|kill|stupid|idiot|dumb)\b"
LEAKAGE = [
    r"(you\s+are\s+(an?\s+)?(ai|assistant|expert|model))",
    r"(as\s+(an?\s+)?(ai|assistant|model|system))",
    r"(your\s+(task|job|purpose|role|responsibility|goal)\s+is)",
    r"(i\s+(am|cannot|must|will|shall)\s+(not\s+)?(follow|obey|comply))",
    r"(the\s+(system|instruction|prompt|guideline)\s+(says|states|requires))",
    r"(here\s+(are|is)\s+(my|the)\s+(prompt|instruction|guideline))",
]
TRIVIAL_ANSWERS = ["none", "n/a", "na", "cannot be determined", "unknown", "null", "undefined"]
FORMAT_ONLY_ERRORS = [
    "Binary/T-F question", "Answer too long", "Answer format is", "Answer format not specified", "Don't restrict options", "Explanation questions", "Multiple questions detected", "Question must end with", "Test 1 FAILED", "Trick answer",
    "Answer is an extreme value",
]
IMAGE_REFUSALS = [
    "does not support image input", "does not support images", "does not support image", "cannot process images", "cannot process image", "cannot read images", "can't read images", "cannot see images", "text-only model", "text only model",
    "no vision capabilities", "don't have vision", "do not have vision", "unable to see images", "unable to read images", "cannot view images", "can't view images",
]
IMAGE_EVIDENCE = [
    "let me analyze this image", "let me examine this image", "let me look at this image", "analyzing this image", "examining the image", "studying the image", "the image shows", "this image shows", "the figure shows", "this figure shows",
    "the plot shows", "the chart shows", "the graph shows", "the diagram shows", "the image displays", "the figure displays", "the image contains", "the figure contains", "the image depicts", "the figure depicts", "the image presents",
    "the image is a", "this image is a",
]
#: (hint, words in the report that give it); the reason of that name gives it too.
ISSUE_HINTS = [
    ("too_easy", ["simple_lookup", "single_matchmaking", "counting_only", "chart_comparison"]),
    ("wrong_answer", ["calculation_error", "ocr_misread", "panel_mismatch"]),
    ("not_visual", ["text_only_question", "no_image_needed"]),
    ("not_challenging", ["single_step", "no_reasoning_depth"]),
    ("unclear", ["ambiguous_question", "multiple_interpretations"]),
]
