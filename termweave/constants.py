"""Fixed values that results depend on: seeds, stop words, patterns, months and thresholds."""

from __future__ import annotations

#: Default seeds, in order.
SEEDS = (
    "AI", "ML", "artificial intelligence", "intelligent", "smart", "automated", "algorithm", "chatbot", "facial recognition",
    "FRT", "ANPR", "predictive", "analytics", "GPT", "SafeCity", "Safe City", "Smartcity", "Smart City",
)

#: Words that may not begin or end a phrase.
STOP = frozenset("""the a an and or of in to for on at by with from as is are was were be been
being this that these those it its his her their our your my we you they he she
i has have had do does did will would shall should may might can could must not
no nor but if then than so such also more most other some any all both each few
own same too very s t don now d ll m o re ve y ain shri smt dr km lakh crore
government india indian ministry department minister union state states national
new delhi press information bureau said says today year years month months day days
also including various total per cent percent number one two three four five
under over during through between among about after before while since upon
shall hon ble sri via etc vide inter alia""".split())

#: First words that make a name a person's, and words that make it an organisation's.
HONORIFIC = frozenset("shri smt sh dr prof mr mrs ms hon hon'ble shrimati kumari".split())
OFFICE = frozenset("""ministry department secretariat commission council authority
board bureau office cabinet committee corporation institute organisation organization""".split())

#: Patterns of a capitalised name, of a bare acronym, of an office's abbreviation, and of what follows a system's name.
CAPITALS = r"\b([A-Z][A-Za-z0-9]{2,}(?:\s+[A-Z][A-Za-z0-9]{2,}){0,3})\b"
ACRONYM = r"^[A-Z]{2,6}s?$"
ABBREVIATION = r"^(?:Mo|Do|Dept)[A-Z]"
SYSTEM = r"^(?:platform|portal|system|systems|app|application|tool|toolkit|mission|model|engine|dashboard|chatbot|bot|software|module|suite|framework|initiative|scheme|programme|program|project|solution|technology)\b"
#: Fixed value: the channel of names found near a term.
NEAR = "near-AI name"

#: Terms that never come in by expansion.
BLOCKED = frozenset({"intelligence", "smart cities mission", "digital india"})

#: Name shapes, to be read with word edges at either side, and their labels.
SHAPES = (
    ("[A-Za-z]{2,}GPT", "*GPT"),
    ("Smart[A-Z][A-Za-z]{2,}", "Smart*"),
    ("[A-Za-z]{3,}[-–]AI|AI[-–][A-Za-z]{3,}", "AI-*"),
    (r"[A-Z][A-Za-z]{2,}\s?Drishti", "*Drishti"),
    ("[A-Za-z]{3,}(?:bot|Bot)", "*bot"),
)

#: What a text with a name of each shape holds, one of these at least.
SHAPE_PARTS = {"*GPT": ("GPT",), "Smart*": ("Smart",), "AI-*": ("AI",), "*Drishti": ("Drishti",), "*bot": ("bot", "Bot")}

#: Months by full name and by their first three letters.
MONTHS = "january february march april may june july august september october november december".split()

#: Header lines that are no ministry.
MASTHEAD, GOVERNMENT = "Press Information Bureau", "government of india"

#: ministry_id and canonical_name.
MINISTRIES = (
    (0, "All Ministries"),
    (80, "AYUSH"),
    (61, "Cabinet"),
    (62, "Cabinet Committee Decisions"),
    (63, "Cabinet Committee on Economic Affairs (CCEA)"),
    (70, "Cabinet Committee on Infrastructure"),
    (75, "Cabinet Committee on Investment"),
    (71, "Cabinet Committee on Price"),
    (68, "Cabinet Secretariat"),
    (56, "Department of Atomic Energy"),
    (45, "Department of Ocean Development"),
    (14, "Department of Space"),
    (35, "Election Commission"),
    (1330, "Finance Commission"),
    (57, "Min for Develop. of North-East Region"),
    (27, "Min of Agriculture"),
    (58, "Min of Agro & Rural Industries"),
    (41, "Min of Chemicals and Fertilizers"),
    (26, "Min of Civil Aviation"),
    (42, "Min of Coal"),
    (16, "Min of Commerce & Industry"),
    (24, "Min of Comm. & Information Technology"),
    (60, "Min of Company Affairs"),
    (39, "Min of Consumer Affairs, Food & Public Distribution"),
    (66, "Min of Corporate Affairs"),
    (17, "Min of Culture"),
    (33, "Min of Defence"),
    (48, "Min of Disinvestment"),
    (73, "Min of Drinking Water & Sanitation"),
    (67, "Min of Earth Science"),
    (81, "Min of Electronics & IT"),
    (30, "Min of Environment and Forests"),
    (4, "Min of External Affairs"),
    (15, "Ministry of Finance"),
    (1340, "Ministry of Fisheries, Animal Husbandry & Dairying"),
    (40, "Min of Food Processing Industries"),
    (31, "Min of Health and Family Welfare"),
    (53, "Min of Heavy Ind. & Public Enterprises"),
    (5, "Min of Home Affairs"),
    (32, "Min of Housing & Urban Affairs"),
    (47, "Min of Housing and Urban Poverty Alleviation"),
    (8, "Min of Human Resource Development"),
    (11, "Min of Information & Broadcasting"),
    (1336, "Ministry of Jal Shakti"),
    (21, "Min of Labour & Employment"),
    (7, "Min of Law & Justice"),
    (51, "Min of Micro,Small & Medium Enterprises"),
    (44, "Min of Mines"),
    (65, "Min of Minority Affairs"),
    (28, "Min of New and Renewable Energy"),
    (59, "Min of Overseas Indian Affairs"),
    (10, "Min of Panchayati Raj"),
    (12, "Min of Parliamentary Affairs"),
    (6, "Min of Personnel, Public Grievances & Pensions"),
    (20, "Min of Petroleum & Natural Gas"),
    (79, "Min of Planning"),
    (52, "Min of Power"),
    (23, "Ministry of Railways"),
    (69, "Min of Road Transport & Highways"),
    (43, "Min of Rural Development"),
    (13, "Min of Science & Technology"),
    (46, "Min of Shipping"),
    (77, "Min of Skill Development and Entrepreneurship"),
    (50, "Min of Social Justice & Empowerment"),
    (55, "Min of Statistics & Programme Implementation"),
    (18, "Min of Steel"),
    (25, "Min of Surface Transport"),
    (19, "Min of Textiles"),
    (36, "Ministry of Tourism"),
    (49, "Min of Tribal Affairs"),
    (38, "Ministry of Water Resources"),
    (64, "Min of Women and Child Development"),
    (9, "Min of Youth Affairs and Sports"),
    (78, "NITI Aayog"),
    (1406, "Office of Principal Scientific Advisor to GoI"),
    (72, "Other Cabinet Committees"),
    (99, "Others"),
    (1005, "PIB Headquarters"),
    (22, "Planning Commission"),
    (74, "PMEAC"),
    (1, "President's Secretariat"),
    (3, "Prime Minister's Office"),
    (37, "Special Service and Features"),
    (34, "UPSC"),
    (2, "Vice President's Secretariat"),
)
