"""Personal names as people type them: shared by the operators on speakers, names and personal data."""

from __future__ import annotations

import re
import unicodedata

# Short forms and the given names they stand for (lower case, without accents).
NICKNAMES = {
    "alex": "alexander alexandra alexandria", "al": "albert alan alexander alfred", "andy": "andrew", "drew": "andrew", "amy": "amelia", "millie": "amelia emily camilla mildred", "mel": "amelia melanie melissa",
    "anne": "anneliese annabel", "annie": "anne anna anneliese", "anni": "anneliese", "lise": "anneliese elisabeth", "liesl": "anneliese elisabeth", "art": "arthur", "bab": "barbara", "babs": "barbara", "barb": "barbara", "barbie": "barbara", "bea": "beatrice beatrix", "trixie": "beatrice beatrix", "ben": "benjamin benedict", "benny": "benjamin", "benji": "benjamin",
    "bert": "albert herbert robert", "beth": "elizabeth bethany", "betty": "elizabeth", "bess": "elizabeth", "liz": "elizabeth", "lizzy": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth", "lisa": "elizabeth", "libby": "elizabeth", "bill": "william", "billy": "william", "will": "william", "willy": "william", "liam": "william", "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert",
    "carrie": "caroline", "caro": "caroline", "lina": "caroline carolina katarzyna", "cat": "catherine", "cathy": "catherine", "kate": "catherine katherine katarzyna", "katie": "catherine katherine", "kathy": "catherine katherine", "kitty": "catherine katherine", "kit": "christopher catherine katherine", "kasia": "katarzyna", "kaska": "katarzyna", "charlie": "charles charlotte", "chuck": "charles", "chaz": "charles", "chris": "christopher christian christine christina", "topher": "christopher", "cris": "cristina christopher",
    "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard", "dom": "dominic dominique", "nic": "dominic nicholas nicole", "don": "donald", "dot": "dorothy", "dottie": "dorothy", "ed": "edward edmund edwin", "eddie": "edward edmund", "ned": "edward edmund", "ted": "edward theodore", "teddy": "edward theodore", "theo": "theodore", "ellie": "eleanor ellen", "nell": "eleanor ellen helen", "nellie": "eleanor ellen", "nora": "eleanor honora", "lena": "magdalena helena eleanor", "leni": "magdalena helena", "magda": "magdalena", "maggie": "magdalena margaret", "meg": "margaret", "peg": "margaret", "peggy": "margaret", "madge": "margaret", "greta": "margaret", "rita": "margaret",
    "em": "emma emily emmanuel", "manny": "emmanuel manuel", "manu": "emmanuel manuel", "fred": "frederick alfred", "freddie": "frederick alfred", "freddy": "frederick", "fritz": "frederick friedrich", "fern": "fernando", "nando": "fernando", "ferdi": "ferdinand fernando", "gabi": "gabriela gabriele", "gabby": "gabriela gabrielle", "gabe": "gabriel", "greg": "gregory", "gerry": "gerald gerard", "geoff": "geoffrey", "hank": "henry", "harry": "henry harold", "hal": "henry harold", "hanne": "hannelore hannah johanna", "hanna": "hannelore johanna", "lore": "hannelore eleonore", "hattie": "harriet henrietta", "etta": "henrietta", "hetty": "henrietta", "henny": "henrietta", "izzy": "isabella isabel", "bella": "isabella annabella", "isa": "isabella isabel",
    "jack": "john jackson", "jackie": "jacqueline", "jacqui": "jacqueline", "jake": "jacob", "jim": "james", "jimmy": "james", "jamie": "james", "jen": "jennifer", "jenny": "jennifer", "jess": "jessica", "jo": "josephine joanna joseph jonathan", "josie": "josephine", "joey": "joseph", "joe": "joseph", "jon": "jonathan", "jonny": "jonathan", "johnny": "john jonathan", "ken": "kenneth", "kenny": "kenneth", "larry": "lawrence laurence", "laurie": "lawrence laura", "leo": "leonardo leonard leopold", "len": "leonard leonardo", "lenny": "leonard leonardo", "luci": "lucinda", "lucy": "lucinda", "cindy": "lucinda cynthia",
    "matt": "matthew matthias", "matti": "matthias", "mattie": "matthew matthias matilda", "mike": "michael", "mick": "michael", "mickey": "michael", "mitch": "mitchell", "nadi": "nadia", "nat": "nathaniel nathan natalie", "nate": "nathaniel nathan", "nathan": "nathaniel", "nick": "nicholas", "nicky": "nicholas nicole", "klaus": "nicholas", "liv": "olivia", "livvy": "olivia", "ollie": "oliver olivia", "olu": "oluwaseun", "seun": "oluwaseun", "pat": "patricia patrick", "patty": "patricia", "patti": "patricia", "tricia": "patricia", "trish": "patricia", "pete": "peter", "phil": "philip", "pip": "philip", "pri": "priyanka", "priya": "priyanka",
    "rafe": "raphael", "raph": "raphael", "rafa": "raphael rafael", "becca": "rebecca", "becky": "rebecca", "reba": "rebecca", "rich": "richard", "rick": "richard", "ricky": "richard", "ron": "ronald", "sal": "sally salvatore", "sam": "samuel samantha", "sammy": "samuel", "steph": "stephanie", "steffi": "stephanie", "stevie": "stephanie steven", "steve": "steven stephen", "sue": "susan", "sukie": "susan", "suri": "suresh", "terry": "theresa terence", "tess": "therese theresa", "tessa": "therese theresa", "resi": "therese theresia", "thea": "dorothea theodora", "tim": "timothy", "timmy": "timothy", "tina": "christina valentina martina", "val": "valentina valerie", "tom": "thomas", "tommy": "thomas", "tony": "anthony antonio", "ursi": "ursula", "ulla": "ursula", "uschi": "ursula", "vic": "victor victoria", "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "vin": "vincent", "vinny": "vincent", "vinnie": "vincent", "vince": "vincent", "wally": "walter", "walt": "walter", "xio": "xiomara", "mara": "xiomara tamara", "yas": "yasmin", "yazzy": "yasmin", "zac": "zacharias zachary", "zach": "zacharias zachary", "zack": "zacharias zachary", "zak": "zacharias", "zo": "zoe",
    "hanni": "hannelore johanna hannah", "nacho": "ignacio", "sasha": "alexander alexandra", "sascha": "alexander", "hettie": "henrietta harriet", "matze": "matthias", "paco": "francisco", "pepe": "jose", "hans": "johannes", "uli": "ulrich ulrike", "gitta": "brigitte", "mia": "maria", "nina": "antonina christina", "toni": "antonia anton", "lupe": "guadalupe", "sandy": "alexandra sandra", "xandra": "alexandra",
}
# Given names in wide use, beside those of the reference list a caller passes.
GIVEN_NAMES = (
    "alexander amelia andrew anneliese anthony barbara beatrice benjamin caroline catherine charles christopher daniel david deborah dominic dorothy edward eleanor elizabeth emily emma emmanuel fernando "
    "frederick gabriela george gregory hannelore harriet helen henrietta henry isabella jacqueline james jennifer jessica john jonathan joseph josephine katarzyna katherine kenneth lawrence leonardo "
    "lucinda magdalena margaret maria martin matthew matthias michael nadia nathaniel nicholas nicole olivia oluwaseun patricia patrick peter philip priyanka raphael rebecca richard robert samuel sarah "
    "stephanie steven suresh susan theodore theresa therese thomas timothy ursula valentina victoria vincent walter william xiomara yasmin zacharias zoe"
).split()
TITLES = {"dr", "mr", "mrs", "ms", "miss", "mx", "prof", "sir", "dame", "rev", "herr", "frau"}
LEGAL_FORMS = {"inc", "ltd", "limited", "llc", "plc", "gmbh", "ag", "company", "co", "corp", "corporation", "incorporated", "group", "bv", "sa", "kg"}
UNKNOWN_VOICE = re.compile(r"^(?:\W*|(?:un(?:known|identified|named)|some|other|any)?\s*(?:speaker|voice|participant|person|caller)?|unknown|unidentified|anonymous|n/?a|not available|none|tbd|inaudible)\W*$", re.I)
NUMBERED = re.compile(r"^(?:speaker|voice|participant|spk|s)[\s_#.-]*0*(\d{1,6})$", re.I)
_FULL = {short: set(names.split()) for short, names in NICKNAMES.items()}


def fold(text: str) -> str:
    """Lower case without accents; letters that don't decompose go to their base letter."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return plain.translate(str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"}))


def same_given(a: str, b: str) -> bool:
    """Folded given names that are equal, or one the short form of the other, or both of one name."""
    if a == b:
        return True
    fa, fb = _FULL.get(a, set()), _FULL.get(b, set())
    return a in fb or b in fa or bool(fa & fb)


def full_forms(name: str) -> list[str]:
    return sorted(_FULL.get(name, ()))


def bare(label: str) -> str:
    """A typed label without markup, titles, remarks in brackets and outer marks; the order of "Family, Given" is put right."""
    s = re.sub(r"^<v(?:\.\S+)?\s*([^>]*)>?$", r"\1", label.strip())
    s = re.sub(r"[(\[{][^)\]}]*[)\]}]", " ", s)
    s = re.sub(r"[*_\"“”<>]+", " ", s).strip(" :;-–—\t\n")
    m = re.match(r"^([^,]+),\s*([^,]+)$", s)
    if m and m.group(2).strip(" .").lower() not in LEGAL_FORMS:
        s = f"{m.group(2)} {m.group(1)}"
    words = [w for w in s.split() if w]
    while len(words) > 1 and words[0].lower().strip(".") in TITLES:
        words.pop(0)
    return " ".join(words)
