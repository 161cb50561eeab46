"""Word lists and tables. All are defaults: the functions that use them take others."""

# They must stay as they are for right results.

SKILLS = (
    "python", "java", "javascript", "typescript", "c", "cpp", "csharp", "go", "rust", "swift", "kotlin", "ruby", "php", "scala", "r",
    "bash", "shell", "html", "css", "sql", "graphql", "jquery", "t-sql", "tsql", "pl/sql", "plsql", "nosql",
    "react", "reactjs", "angular", "vue", "vuejs", "nextjs", "nuxtjs", "node", "nodejs", "express", "fastapi", "django", "flask", "spring",
    "rails", "laravel", "svelte", "redux", "mobx", "enzyme", "jest", "webpack", "vite", "babel",
    "pytorch", "tensorflow", "keras", "scikit", "pandas", "numpy", "spark", "kafka", "airflow", "dbt", "mlflow",
    "aws", "azure", "gcp", "docker", "kubernetes", "terraform", "ansible", "jenkins", "githubactions", "circleci", "helm",
    "postgresql", "mysql", "mongodb", "redis", "elasticsearch", "sqlite", "dynamodb", "cassandra", "neo4j",
    "git", "linux", "nginx", "rest", "grpc", "data migration", "database design", "database optimization", "data modeling", "etl", "data warehousing",
    "stakeholder management", "audit", "reconciliation", "information technology",
    "ui/ux", "ux", "ui", "figma", "tailwind", "sass", "agile", "scrum", "kanban", "ci/cd", "tdd", "bdd",
    "restful", "websocket", "api", "soap", "oauth", "s3", "ec2", "lambda",
    "sap", "abap", "crm", "salesforce", "hubspot", "marketing", "digital marketing", "telemarketing", "sales", "erp",
    "bentley", "autodesk", "projectwise", "kpi", "kpis", "qa", "quality assurance", "business intelligence", "power bi",
)

# Sections and their keywords; the order of both decides.
SECTIONS = (
    ("experience", ("experience", "professional experience", "employment", "employment history", "work history", "work experience", "relevant experience", "internship experience")),
    ("education", ("education", "academic background", "academic")),
    ("skills", ("skills", "technical skills", "core skills", "key skills", "competencies", "technologies", "technical skill")),
    ("_strengths", ("strengths",)),
    ("_passions", ("passions", "interests", "hobbies")),
    ("_certifications", ("certification", "certifications", "licenses")),
    ("_awards", ("awards", "achievements", "accomplishments")),
    ("_projects", ("projects", "personal projects", "portfolio")),
    ("_summary", ("summary", "professional summary", "profile", "objective", "about me")),
    ("_references", ("references",)),
)

# Words that make no name.
NAME_STOPWORDS = ("summary", "objective", "resume", "curriculum vitae", "cv", "profile", "contact", "personal information", "skills", "experience", "education", "references", "projects", "certifications", "achievements")
HEADERS = (
    "summary", "objective", "skills", "experience", "education", "projects", "certifications", "achievements", "references", "employment", "work history",
    "academic", "languages", "tools", "strengths", "passions", "certification", "interests", "awards", "volunteering", "publications", "hobbies",
)
SKILL_PHRASE_WORDS = ("programming", "development", "management", "integration", "languages", "technical", "skills", "oriented", "analytical", "thinking", "evaluation", "optimization", "methodology")

# Codes and names of states.
STATE_CODES = tuple("AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split())
STATES = (
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho", "illinois",
    "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota", "mississippi", "missouri",
    "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york", "north carolina", "north dakota", "ohio", "oklahoma",
    "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia", "washington",
    "west virginia", "wisconsin", "wyoming",
)

# Literal repairs of misread text, in order.
OCR_REPAIRS = (
    ("SOL", "SQL"), ("sol ", "sql "), ("ClaireQL", "SQL"), ("t-sql", "tsql"), ("I ve", "I've"), ("i ve", "i've"),
    ("Bachelor s", "Bachelor's"), ("bachelor s", "bachelor's"), ("Master s", "Master's"), ("master s", "master's"),
    ("Camputer", "Computer"), ("camputer", "computer"), ("Phitadelphia", "Philadelphia"), ("phitadelphia", "philadelphia"),
    ("campany", "company"), ("Campany", "Company"),
)

# Headers and confidences of the quality measures.
QUALITY_HEADERS = ("experience", "education", "skills", "summary", "work")
PARSER_CONFIDENCE = (("ok", 1.0), ("low_text", 0.62), ("empty", 0.0), ("noisy_symbols", 0.45))

# Items of entity lists that are none.
JUNK_ENTITIES = (":", "-", "–", "—", ".", ",", "n", "oh", "o", "um", "uh", "ha")
EXPERIENCE_HEADERS = ("experience", "work experience", "professional experience", "relevant experience", "employment", "employment history", "work history", "career history", "professional background")
EDUCATION_HEADERS = ("education", "academic", "academics", "qualifications", "educational background", "academic background")
EXPERIENCE_JUNK = ("han", "ge", "um", "uh", "ologies", "metho")
EXPERIENCE_TAILS = ("zation", "ization", "isation", "ations", "tions", "ments", "sions", "ology", "ologies")
EXPERIENCE_CODES = ("ES", "US", "IT", "FR", "UK", "HR", "PR", "ER", "DR", "MS")
BAD_NAME_WORDS = ("skills", "experience", "education", "summary", "resume", "http")

# Labels of spans.
ENTITY_LABELS = ("NAME", "SKILL", "EDUCATION", "EXPERIENCE", "COMPANY", "DATE", "LOCATION")
