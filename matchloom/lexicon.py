"""Word lists, patterns and section terms.

Everything here is a fixed value: results depend on these exact strings, so they
are stated plainly and every function that uses one takes it as a parameter.
"""

from __future__ import annotations

# The English list of Spark's StopWordsRemover. It serves both the
# keyword sets and the TF-IDF terms; pass another list to either one.
STOP_WORDS = (
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his
    himself she her hers herself it its itself they them their theirs themselves what which
    who whom this that these those am is are was were be been being have has had having do
    does did doing a an the and but if or because as until while of at by for with about
    against between into through during before after above below to from up down in out on
    off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will
    just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
    they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't
    wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't
    shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
    what's when's where's who's why's would
    """
).split()

# Terms tagged as skills when they stand as whole words. Each list
# is matched on its own, so a hit in one never hides a hit in another.
SKILL_TAG_GROUPS = (
    ("python", "java", "javascript", "c++", "c#", "ruby", "go", "rust", "php", "swift",
     "kotlin", "scala", "r", "matlab", "perl"),
    ("react", "angular", "vue", "django", "flask", "spring", "nodejs", "express", "fastapi",
     "rails", "laravel"),
    ("tensorflow", "pytorch", "keras", "scikit-learn", "pandas", "numpy", "opencv", "nltk",
     "spacy"),
    ("aws", "azure", "gcp", "docker", "kubernetes", "jenkins", "git", "terraform", "ansible"),
    ("mysql", "postgresql", "mongodb", "redis", "elasticsearch", "cassandra", "oracle",
     "sql server"),
    ("machine learning", "deep learning", "nlp", "computer vision", "data science", "ai", "ml",
     "dl"),
    ("html", "css", "sass", "less", "bootstrap", "tailwind", "jquery", "ajax", "rest", "api",
     "graphql"),
    ("linux", "unix", "windows", "bash", "shell", "powershell", "vim", "vscode", "intellij",
     "eclipse"),
    ("agile", "scrum", "kanban", "jira", "confluence", "slack", "teams", "devops", "ci/cd"),
)

# Terms counted as profile skills wherever they occur as a substring.
SKILL_SUBSTRINGS = (
    # languages
    "python", "java", "javascript", "typescript", "c++", "c#", "ruby", "go", "rust", "php",
    "swift", "kotlin", "scala", "r", "matlab", "perl", "shell", "bash", "powershell", "sql",
    "html", "css", "sass", "less",
    # frameworks
    "react", "angular", "vue", "django", "flask", "fastapi", "spring", "spring boot", "nodejs",
    "node.js", "express", "rails", "laravel", "asp.net", "jquery", "bootstrap", "tailwind",
    "material-ui", "tensorflow", "pytorch", "keras", "scikit-learn", "pandas", "numpy",
    "matplotlib", "seaborn", "opencv",
    # tools
    "git", "github", "gitlab", "bitbucket", "docker", "kubernetes", "jenkins", "aws", "azure",
    "gcp", "heroku", "firebase", "mongodb", "mysql", "postgresql", "redis", "elasticsearch",
    "kafka", "rabbitmq", "nginx", "apache", "linux", "windows", "macos", "android", "ios",
    "react native", "flutter", "unity",
    # data work
    "machine learning", "deep learning", "artificial intelligence", "data science",
    "data analysis", "data mining", "nlp", "natural language processing", "computer vision",
    "neural networks", "reinforcement learning", "big data", "hadoop", "spark", "tableau",
    "power bi", "excel", "statistics",
)

# Candidate phrases taken as skills, and the open length interval they
# must fall in.
SKILL_PHRASE_PATTERNS = (
    r"\b([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)\b",
    r"\b([A-Z]+(?:\.[A-Z]+)*)\b",
)
SKILL_PHRASE_LENGTH = (2, 20)

# Contact patterns. Phone patterns are tried in this order.
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_PATTERNS = (
    r"[\+]?91[-.\s]?[6-9]\d{9}",
    r"[6-9]\d{9}",
    r"[\+]?[1-9]\d{1,14}",
    r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b",
)
LINKEDIN_PATTERN = r"linkedin\.com/in/[\p{L}\p{N}_-]+"
GITHUB_PATTERN = r"github\.com/[\p{L}\p{N}_-]+"

# A line that hits any of these, in any letter case, is an education line.
DEGREE_PATTERNS = (
    r"B\.?Tech|B\.?E\.?|Bachelor",
    r"M\.?Tech|M\.?E\.?|Master",
    r"B\.?Sc|BSc|Bachelor of Science",
    r"M\.?Sc|MSc|Master of Science",
    r"MBA|Master of Business",
    r"B\.?Com|BCom|Bachelor of Commerce",
    r"M\.?Com|MCom|Master of Commerce",
    r"Ph\.?D|PhD|Doctorate",
    r"B\.?C\.?A|BCA",
    r"M\.?C\.?A|MCA",
)

# Terms that open and close the experience section.
EXPERIENCE_STARTS = (
    "work experience", "professional experience", "employment history", "experience",
    "career summary", "professional summary",
)
EXPERIENCE_STOPS = ("education", "skills", "projects", "certifications", "awards")

# Entity labels whose text counts as a skill.
ENTITY_LABELS = ("ORG", "PRODUCT", "WORK_OF_ART")

# What stands in for a missing card field.
NOT_SPECIFIED = "Not specified"
NOT_DISCLOSED = "Not disclosed"
UNKNOWN = "Unknown"
