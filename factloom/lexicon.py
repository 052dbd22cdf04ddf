"""Word lists and patterns, kept as data.

Patterns use only syntax that Java's and RE2's regular expressions share (no look-around), so that the same
text serves both. They are matched against folded text: lower case, straight quotes, single spaces.
"""

from __future__ import annotations

# Words left out by the six tokenisers, lengths, units and thresholds of the data model.
STORY_STOP = set("the a an and or of to in on for with by is are be will must can should via from as that this when after before only also each all not no it its they their them user users customer customers feature system currently works work lets let pickup provide ensure allow include make using used use able then into over up want see know learner role benefit story need so view".split())
GENERIC = set("course learner student user customer admin instructor manager page screen view button field form flow process management support service option setting data app product item list detail section area module feature system platform content info information tool document documents thing things away back later now requirement requirements wrinkle catch exception".split())
LINK_STOP = set("the a an and or of to in on for with by is are be will must can should would via from as that this these those when after before only also each all any not no it its they their them we our you your page screen system feature able into over then there here such per new first release other another".split())
ROUTING_STOP = set("a an the for in on of to and or from as via with by at app flow feature screen page system module new change changing switch switching update updating method option support".split())
TOPIC_STOP = set(
    "the a an and or of to in on for with by is are was were be been this that these those course learner user admin instructor page feature system content customer provider there their them "
    "what when how who which why should would does will can must may happen happens decide decided decision needed still yet resolve resolved confirm not any each some before after within from into "
    "hour hours day days minute minutes week weeks month months year years star stars photo photos dollar dollars percent attempt attempts time times business request requests "
    "one two three four five six seven eight nine ten eleven twelve fifteen twenty thirty forty fifty sixty ninety hundred thousand".split()
)
MERGE_STOP = set("the a an and or of to in on for course learner user admin instructor page feature system content with by is are".split())
QUESTION_WORDS = set("what which who when where why how does do did will would should could can is are there any happen happens clarify clarification confirm".split())
STORY_GLUE = set("within appropriate relevant various certain particular additional additionally whether based according able using via regarding related necessary required available applicable specific same such both either each every their there when once after before while always never also then however instead system product platform tool feature user users the and for".split())
AREA_BAD_LEAD = set("there here this that these those it they we also and but so then the a an yes no ok okay well just both each every all any some another one two three four five ten fifteen twenty".split())
NAME_STOP = set(
    "cannot can cant could couldn would wouldn should shouldn must shall will wont won may might isn aren wasn weren doesn didn don dont hasn haven hadn coming going being doing having getting want wants wanted need needs needed like "
    "then than back also just still yet now here there their them they this that these those anymore instead into onto upon always never often usually sometimes rarely really very quite long short more less most least "
    "said says absolutely airtight actually basically essentially honestly obviously frankly bigger smaller faster slower worse thing stuff part point case way kind sort cycle".split()
)
LEADING_VERBS = set("send add adding show display provide change changed enable allow let make give set use support receive ensure create build keep bump drop remove increase decrease reduce update require include have want need define specify confirm confirmed".split())
NUMBER_WORDS = set("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand hour hours day days week weeks month months minute minutes second seconds percent star stars".split())
DUMP_NAMES = set("misc|general|features|feature|requirements|admin|admin role|roles|system|product|tool|platform|overview|scope".split("|"))
DUMP_LAST = set("features functionality capabilities requirements stuff things items misc".split())
WORD_VALUES = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "fifteen": 15, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "ninety": 90}
TOPIC_SUFFIXES = ("ations", "ation", "ments", "ment", "ing", "ted", "ed", "ies", "es", "s")
MEASURE_UNITS = "hours?|days?|minutes?|weeks?|months?|years?|business days?|stars?|photos?|dollars?|usd|percent|%|attempts?|times?|requests? per minute|per minute"
LOW_BOUNDS = set("at least|minimum|above|more than|over|from".split("|"))
HIGH_BOUNDS = set("below|under|maximum|less than|no more than".split("|"))
BOUNDS = "at least|at most|minimum|maximum|no more than|no less than|more than|less than|above|below|under|over|up to|from"
NUMBER_TOKEN = r"\b(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|fifteen|twenty|thirty|forty|fifty|sixty|ninety|hundred|\d+(?:,\d{3})*(?:\.\d+)?)\b"

# Phrases each classifier reacts to.
BANTER = [
    r"\bmy (?:week|day|days|schedule|workload|plate|life|team|year)\b", r"\bchanges? my\b", r"\bin a good way\b", r"\b(?:i'm|i am|we're|we are) (?:so )?(?:excited|glad|happy|thrilled|relieved|pleased)\b",
    r"\b(?:can't|cannot|can not) wait\b", r"\blooking forward to\b", r"\bgood (?:news|to hear)\b", r"\bthanks?,? (?:everyone|all|so much|for)\b", r"\bhow (?:was|are|did|is) (?:your|the|you)\b", r"\b(?:survived|barely) it\b",
]
ECHO_LEAD = r"^ *(?:yes|no|right|correct|understood|agreed|sure|okay|ok|exactly|indeed|noted|got it|sounds good|makes sense)[ ,.:;-]"
ECHO_WORDS = 11
ASPIRATION = [
    r"\bshould (?:just )?feel\b", r"\bfeels? (?:really |truly )?(?:effortless|seamless|premium|delightful|magical|intuitive|modern|slick|polished|snappy|smooth|clean|elegant|frictionless)\b",
    r"\breally love\b", r"\blove (?:using )?(?:it|the (?:app|product|tool))\b", r"\b(?:best[- ]in|world)[- ]class\b", r"\bnot (?:just )?tolerate\b", r"\bhate expense tools\b", r"\bpeople hate\b",
]
MEASURABLE = r"[0-9]|\b(?:second|minute|hour|day|week|month|percent|kb|mb|gb|page|click|step|field|character)s?\b|%"
_MEETING = "(?:session|meeting|call|sync|invite|slot|review|standup|stand-up|check-?in|checkpoint|catch-?up)"
_DRAFTS = "(?:mockups?|wireframes?|designs?|prototypes?|deck|slides?|artwork|copy)"
_WEEKDAY = "(?:monday|tuesday|wednesday|thursday|friday)"
LOGISTICS = [
    r"\bre-?schedul", rf"\b(?:move|push|shift|bump|change)\b[^.?!]{{0,40}}\b{_MEETING}\b", rf"\b(?:move|push|shift|bump)\b[^.?!]{{0,40}}\bto\b[^.?!]{{0,20}}\b(?:next week|{_WEEKDAY}|[0-9]{{1,2}} ?(?:am|pm)|[0-9]{{1,2}}[:.][0-9]{{2}})",
    r"\bsend\b[^.?!]{0,25}\b(?:an? )?invite\b", r"\bcalendar (?:hold|invite)\b", r"\bsame time next week\b", rf"\b(?:talk|see you|meet|catch up)\b[^.?!]{{0,15}}\b(?:next week|{_WEEKDAY}|then|soon)\b",
    r"\breview (?:the |those |them |it |that )*(?:(?:mockups?|wireframes?|designs?|prototypes?|deck|slides?) )?(?:next time|next week|later|then)\b", r"\bwe'?ll review (?:those|them|it|that)\b[^.?!]{0,25}\b(?:next|later|instead)\b", rf"\b{_DRAFTS}\b[^.?!]{{0,25}}\b(?:late|behind|delayed|slipped|not ready)\b",
    r"\bpick (?:this |it |that )?up next (?:week|time)\b", r"\bregroup next week\b", r"\b(?:circle back|follow up|check back)\b[^.?!]{0,35}\bnext (?:week|time|call)\b",
    r"\b(?:i'?ll|will) (?:re-?)?(?:send|share|forward|circulate|email|drop|post)\b[^.?!]{0,35}\b(?:invite|calendar|note|outline|template|deck|link|spec|summary|minutes|recap|doc|document)s?\b",
    r"\b(?:i'?ll|will) (?:share|send|circulate|follow up|come back|circle back)\b[^.?!]{0,40}\b(?:after|following|by|before) (?:this|the|end of|next) (?:call|meeting|session|day|week)\b",
]
_PARTY = "(?:we|they|the team|finance|legal|product|nobody|no one)"
_DECIDED = "(?:decided|settled|agreed|determined|finali[sz]ed|chosen|nailed (?:it )?down)"
UNDECIDED = [  # negation is required, unlike a bare "finance agreed ..."
    rf"\b{_PARTY} (?:have|has|had|are|is)?(?: not|n't) (?:yet |been )*{_DECIDED}\b", rf"\b(?:haven'?t|hasn'?t|have not|has not|never) (?:yet |been )*{_DECIDED}\b", rf"\b(?:nobody|no one) (?:has |have )?(?:yet )?{_DECIDED}\b",
    r"\bno (?:final )?decision\b", r"\b(?:still|currently) (?:open|undecided|tbd|under discussion|being discussed|in discussion|up in the air)\b", r"\bto be (?:decided|determined|confirmed)\b", r"\btbd\b", r"\bundetermined\b", r"\bopen (?:question|item)\b",
    r"\bstill (?:checking|deciding|discussing|arguing|debating|working (?:it|this) out|figuring (?:it|this) out|to be worked out)\b", r"\bstill (?:being |under )?(?:checked|discussed|decided|reviewed)\b", r"\bnot (?:yet )?decided\b", r"\bdon'?t build (?:it|this|that) yet\b",
    r"\bwe (?:might|may) (?:want to|do|add|build|introduce|consider|offer)\b[^.?!]{0,90}\bnot decided\b", r"\bnot for (?:now|launch|v1|the mvp|version one)\b", r"\bkeep (?:it|this|that) in mind\b", r"\bpark(?:ed|ing)? (?:it|this)\b", r"\brevisit\b[^.?!]{0,30}\blater\b", r"\bdefer(?:red)?\b[^.?!]{0,15}\b(?:to|until)\b", r"\bplaceholder for now\b", r"\bremains? (?:undecided|undetermined|open)\b",
]
RESOLVES = [r"\b(?:resolv|clos|settl|answer)[a-z]+\b[^.?!]{0,25}\b(?:open question|last (?:week|call)|question|it|that)\b", r"\b(?:we|they) (?:have )?(?:decided|agreed|settled|confirmed)\b"]
DECIDED_NOT = r"\b(?:we|they) (?:have )?(?:decided|agreed|settled|confirmed)\b[^.?!]{0,12}\bnot\b"  # settles nothing
HEDGE = [
    r"\bwe (?:may be |might be |are )?misaligned\b", r"\blet me check (?:with|on)\b", r"\bstill (?:checking|discussing|arguing|deciding|not sure)\b", r"\bwe (?:haven'?t|have not) (?:decided|settled|agreed)\b", r"\bnot (?:yet )?(?:sure|decided|settled)\b",
    r"\bto be (?:decided|determined|confirmed)\b", r"\btbd\b", r"\bopen question\b", r"\bwe disagree\b", r"\bwe'?re not aligned\b", r"\bunder discussion\b", r"\bcircle back on\b", r"\brevisit (?:this|that) later\b", r"\bwe might want to\b", r"\bdon'?t build (?:it|that) yet\b", r"\bkeep (?:it|that) in mind for now\b",
]
VERBISH = r"\b(?:is|are|was|were|be|will|shall|should|must|can|may|need|have|has|want|allow|require|send|add|show|keep|make|use|get|give|set|pay|support|include|enter|submit|approve|reject|delegate|calculat|appear|retain|store|export|display|goes?|go|do|does)\b"
NO_CHANGE = [
    r"\bno change\b", r"\bnot chang[a-z]*\b", r"\bunchanged\b", r"\bstays? (?:as (?:it )?is|the same)\b", r"\bstill (?:require[a-z]*|stand[a-z]*|appl[a-z]*|in place|the same|correct|true)\b", r"\bsame (?:rule|as before|thing)\b",
    r"\bas (?:before|is)\b", r"\bremains? (?:the same|unchanged)\b", r"\bjust (?:to )?(?:re)?confirm[a-z]*\b", r"\bre-?confirm[a-z]*\b",
]
NARRATION = r"^(?:please )?(?:adjust|adjusted|maintain|maintained|retain|retained|keep|kept|clarif[a-z]+|discuss[a-z]+|noted?|decided?|agreed?|review[a-z]+|expand[a-z]+|introduc[a-z]+|reaffirm[a-z]+|reiterat[a-z]+|address[a-z]+|defin[a-z]+|establish[a-z]+|determin[a-z]+)\b"
VAGUE_GAP = [
    r"\bfailure conditions?\b", r"\bedge cases?\b", r"\berror handling\b", r"\bcorner cases?\b", r"\bhow (?:is|are|will) (?:this|it|these|that) (?:be )?handled\b", r"\bwhat are the (?:requirements|rules|details|specifics|conditions|expectations|constraints|parameters)\b",
    r"\bany(?: other| additional| further|thing else)\b", r"\b(?:further (?:details|clarification)|more (?:detail|information)|what (?:else|other things)|is there anything)\b",
]
LIMIT_QUESTION = r"\b(?:maximum|minimum|max|min|how many|how much|what (?:is|are) the (?:limit|range|number|count))\b"
STATED_RANGE = r"\b(?:one|two|three|four|five|ten|[0-9]+)\b[^.?!]{0,20}\b(?:to|-|through|and)\b[^.?!]{0,10}\b(?:one|two|three|four|five|ten|[0-9]+)\b|\bup to [0-9]+|\bbetween [a-z0-9]+ and [a-z0-9]+"
SCALE = r"\b(?:one|1) to (?:five|ten|[0-9]+)\b"
QUOTE_FILLER = r"(?i)^(?:so|okay|ok|yeah|yes|no|well|right|sure|and|but|also|actually|look|listen|hold on|i mean|you know)[,\s]+"
STUB_VERBS = r"implement|build|define|specify|create|set\s*up|add(?:\s+support\s+for)?|introduce|develop|design|configure|enable"
CLAUSE_BREAK = r"\s*;\s*|,\s+but\s+|\s+but\s+|\.?\s+however,?\s+|,?\s+whereas\s+|,\s+and\s+"


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)
