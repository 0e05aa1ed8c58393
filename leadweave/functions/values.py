"""Word lists, tables and patterns that results depend on. Data, no logic."""

from __future__ import annotations

#: Titles that tell of articles and learning pages.
INFORMATIONAL_TERMS = (
    "admission", "admissions", "college", "colleges", "university", "universities", "fees", "fee structure", "placement", "placements",
    "syllabus", "scholarship", "scholarships", "exam", "exams", "entrance", "cutoff", "cutoffs",
    "tutorial", "tutorials", "course", "courses", "learn", "learning", "documentation", "docs", "guide", "guides", "examples", "example",
    "introduction", "beginner", "cheatsheet", "how to", "step by step",
    "wikipedia", "definition", "what is", "meaning", "overview", "history", "encyclopedia", "explained", "types of",
    "blog", "news", "article", "magazine", "newsletter", "podcast",
    "forum", "community", "discussion", "question", "questions", "answers", "answer", "faq", "thread",
    "ranking", "rankings", "top 10", "top 5", "top 7", "top 15", "top 20", "comparison", "best ", "vs ", "versus", "review", "reviews",
    "jobs", "job openings", "careers", "hiring", "vacancy", "vacancies", "internship",
)
#: Words of company names.
BUSINESS_HINTS = (
    "agency", "automation", "companies", "company", "consulting", "consultancy", "corp", "corporation", "enterprise", "enterprises",
    "firm", "firms", "group", "inc", "incorporated", "industrial", "industries", "limited", "llc", "ltd", "provider", "services",
    "software", "solutions", "startup", "systems", "technologies", "technology", "ventures",
)
#: Hosts, host labels and names that are no business leads.
NON_COMPANY_DOMAINS = (
    "collegedunia", "careers360", "shiksha", "getmyuni", "collegesearch", "engineering360", "entrancezone", "collegevidya",
    "wikipedia", "britannica", "investopedia", "encyclopedia", "merriam-webster", "python.org", "pypi.org", "programiz", "w3.org",
    "geeksforgeeks", "tutorialspoint", "w3schools", "javatpoint", "coursera", "udemy", "edx", "khanacademy", "skillshare", "freecodecamp",
    "codecademy", "simplilearn", "pluralsight", "udacity", "nptel",
    "google", "play", "apple", "microsoft", "whatsapp", "x",
    "quora", "reddit", "stackoverflow", "stackexchange", "zhihu",
    "medium", "substack", "hashnode", "dev", "youtube", "youtu", "techcrunch", "theverge", "wired", "forbes", "businessinsider",
    "economictimes", "hindustantimes", "timesofindia", "businessstandard", "thehindu", "livemint",
    "glassdoor", "indeed", "naukri", "shine", "ambitionbox", "linkedin",
    "npmjs", "pypi", "github", "g2", "capterra", "trustpilot", "getapp", "sulekha", "indiamart", "tradeindia",
)
#: Labels that are suffixes, not names.
SUFFIX_LABELS = ("com", "org", "net", "edu", "gov", "co", "in", "io", "tech", "ai", "app", "info", "biz")
BUSINESS_SUFFIXES = ("ai", "app", "biz", "co", "com", "in", "info", "io", "net", "org", "tech")
#: Names that a host label stands for.
NAME_OVERRIDES = {
    "abb": "ABB", "adobe": "Adobe", "amazon": "Amazon", "automationanywhere": "Automation Anywhere", "aws": "AWS", "bosch": "Bosch",
    "freshworks": "Freshworks", "ge": "GE", "google": "Google", "hcl": "HCL", "hp": "HP", "ibm": "IBM", "infosys": "Infosys",
    "microsoft": "Microsoft", "openai": "OpenAI", "oracle": "Oracle", "rockwellautomation": "Rockwell Automation", "salesforce": "Salesforce",
    "sap": "SAP", "siemens": "Siemens", "tcs": "TCS", "uipath": "UiPath", "wipro": "Wipro", "zoho": "Zoho",
}
#: Parts of titles that name the site, not the company.
TITLE_NOISE = ("ambitionbox", "capterra", "clutch", "crunchbase", "g2", "getapp", "glassdoor", "goodfirms", "indeed", "justdial", "linkedin", "naukri", "trustpilot", "zoominfo")
#: Placeholders that are no company names.
NAME_PLACEHOLDERS = (
    "about us", "contact", "contact us", "home", "homepage", "products", "services", "founder", "ceo", "leadership", "team", "our team", "about",
    "portfolio", "careers", "privacy policy", "terms of service", "welcome", "about the company",
)
#: Host part to the label of a source; the default.
SOURCE_LABELS = {
    "linkedin.com": "LinkedIn", "clutch.co": "Clutch", "goodfirms.co": "GoodFirms", "justdial.com": "Justdial", "crunchbase.com": "Crunchbase",
    "wellfound.com": "Wellfound", "angel.co": "AngelList", "apollo.io": "Apollo", "zoominfo.com": "ZoomInfo",
}
SOURCE_LABEL = "Google"
#: Suffixes of government hosts, and forum domains.
GOVERNMENT_SUFFIXES = (".gov", ".gov.in", ".gov.uk", ".gov.au", ".gov.us", ".gov.ca", ".nic.in", ".gov.sg", ".govt.nz")
FORUM_DOMAINS = ("reddit.com", "quora.com", "stackoverflow.com", "stackexchange.com", "zhihu.com", "medium.com", "dev.to", "hashnode.dev", "hackernews.com", "news.ycombinator.com")
#: Starts of local parts in order, and parts of those of machines.
EMAIL_PREFIXES = ("founder", "ceo", "sales", "business", "partnership", "bd", "hello", "info", "contact", "support")
EMAIL_IGNORED = (
    "noreply", "no-reply", "no_reply", "donotreply", "do-not-reply", "bounce", "bounces", "unsubscribe", "notification", "notifications",
    "tracking", "newsletter", "mailer", "maildaemon", "mail-daemon", "postmaster", "marketing", "automated", "system", "alert", "alerts", "webmaster",
)
#: How a sentence starts and what it holds.
SENTENCE_STARTS = ("what ", "how ", "why ", "when ", "where ", "which ", "top ", "best ", "is ", "are ", "the ", "a ")
SENTENCE_TERMS = ("tutorial", "guide", "definition", "vs", "versus", "comparison", "meaning", "overview", "documentation", "reference")
#: Signs of a challenge instead of a page, and types of pages.
CHALLENGES = (
    "cf-browser-verification", "just a moment", "enable javascript and cookies to continue", "/_cf/", "challenge-platform", "ddos-guard",
    "perimeterx", "px-captcha", "window._cf_chl", "challenge-error-title", "recaptcha",
)
HTML_TYPES = ("text/html", "application/xhtml")
#: Suffixes of candidate domains, and words left out of their names.
CANDIDATE_SUFFIXES = (".com", ".in", ".co.in", ".io", ".org", ".ai")
CANDIDATE_STOP = ("pvt", "ltd", "private", "limited", "inc", "llp", "technologies", "technology", "solutions", "services", "consulting", "group")
#: Terms of an error text and its class, in order.
ERROR_CLASSES = (
    ("captcha", ("captcha",)), ("sorry_page", ("sorry",)), ("enablejs", ("enablejs",)), ("consent_page", ("consent",)), ("parser_failure", ("parse",)), ("zero_results", ("zero",)),
    ("certificate_failure", ("certificate", "ssl cert", "local issuer", "self signed")), ("tls_failure", ("ssl", "tls", "handshake")), ("timeout", ("timeout", "timed out", "deadline", "curl: (28)")),
    ("dead_connection", ("connection closed", "connection reset", "connection refused", "connect failed", "proxy connect aborted", "rejected by the socks5 server", "curl: (56)", "curl: (97)")),
    ("rate_limit", ("429", "rate limit", "too many requests")),
)
#: Points that an outcome adds to or takes from a score of 0 to 100.
SCORE_STEPS = {"valid_results": 8.0, "captcha": -10.0, "rate_limit": -8.0, "dead_connection": -6.0, "tls_failure": -6.0, "certificate_failure": -6.0, "timeout": -5.0, "parser_failure": -2.0, "zero_results": 0.0, "valid_zero_results": 0.0}
SCORE_STEP = -5.0

#: Keyword classes.
ROLE_WORDS = (
    "engineer", "engineers", "developer", "developers", "designer", "designers", "manager", "managers", "director", "directors", "founder", "founders",
    "ceo", "cto", "coo", "cfo", "cmo", "president", "consultant", "consultants", "architect", "architects", "freelancer", "freelancers",
    "recruiter", "recruiters", "analyst", "analysts", "intern", "interns", "scientist", "scientists", "researcher", "researchers",
    "programmer", "programmers", "specialist", "specialists", "executive", "executives", "officer", "officers", "administrator", "administrators",
    "hr", "sales rep", "account manager", "project manager", "product manager", "marketing manager",
)
TECHNOLOGY_WORDS = (
    "python", "java", "javascript", "typescript", "golang", "go", "rust", "c++", "c#", "php", "ruby", "scala", "kotlin", "swift",
    "react", "angular", "vue", "django", "flask", "fastapi", "spring", "node", "nodejs", "next.js", "nuxt",
    "kubernetes", "docker", "terraform", "ansible", "aws", "azure", "gcp", "tensorflow", "pytorch", "scikit-learn", "opencv",
    "sql", "postgresql", "mysql", "mongodb", "redis", "elasticsearch", "blockchain", "ethereum", "solidity",
    "rpa", "uipath", "automation anywhere", "blue prism", "tableau", "powerbi", "power bi", "looker", "dbt",
    "hadoop", "spark", "kafka", "airflow", "android", "ios", "flutter", "react native", "ai", "ml", "nlp", "llm", "gpt",
    "selenium", "cypress", "playwright", "devops", "ci/cd", "jenkins",
)
PRODUCT_WORDS = (
    "crm", "erp", "hrms", "hris", "cms", "lms", "saas", "paas", "iaas", "pos", "point of sale", "accounting software", "inventory management",
    "project management software", "chatbot", "helpdesk", "ticketing", "dashboard", "api gateway", "data warehouse", "analytics platform",
    "ecommerce platform", "payment gateway", "billing software",
)
SERVICE_WORDS = (
    "digital marketing", "seo", "sem", "ppc", "content marketing", "email marketing", "social media marketing", "smm", "web design", "web development",
    "app development", "mobile development", "cloud migration", "cloud consulting", "cybersecurity services", "security audit", "data analytics",
    "business analytics", "staffing", "recruitment", "outsourcing", "managed services", "it support", "testing services", "qa services", "training services",
)
COMPANY_WORDS = (
    "company", "companies", "agency", "agencies", "startup", "startups", "firm", "firms", "business", "businesses", "consultancy", "corp", "corporation",
    "enterprise", "enterprises", "software", "technology", "technologies", "solutions", "solution", "services", "provider", "providers", "vendor", "vendors",
    "manufacturer", "manufacturers", "group", "inc", "ltd", "llc", "pvt", "industry", "industries",
)
#: Words by which a keyword is about persons.
PERSON_WORDS = (
    "engineer", "developer", "designer", "manager", "director", "founder", "ceo", "cto", "coo", "cfo", "president", "consultant", "architect",
    "freelancer", "recruiter", "hr", "marketing", "sales", "analyst", "intern",
)
#: What a keyword with a role, a technology or an industry stands for, in order.
ROLE_EXPANSIONS = {
    "data engineer": ("data engineering company", "data engineering consultancy", "big data company", "ETL consulting company", "data pipeline company"),
    "software engineer": ("software development company", "custom software company", "software engineering firm"),
    "developer": ("software development company", "app development company", "web development agency"),
    "designer": ("UI UX design agency", "product design company", "digital design studio"),
    "machine learning engineer": ("machine learning company", "AI startup", "machine learning consultancy"),
    "devops engineer": ("devops consulting company", "cloud infrastructure company", "devops services company"),
    "security engineer": ("cybersecurity company", "information security firm", "security consulting company"),
    "recruiter": ("staffing company", "recruitment agency", "talent acquisition firm"),
    "hr": ("HR services company", "human resources consulting firm", "HR technology company"),
    "analyst": ("data analytics company", "business analytics firm", "analytics consulting company"),
}
TECHNOLOGY_EXPANSIONS = {
    "python": ("python development company", "python software company", "python consulting firm"),
    "java": ("java development company", "java software company", "enterprise java company"),
    "react": ("react development company", "react.js agency", "frontend development company"),
    "node": ("node.js development company", "nodejs software company"),
    "ai": ("AI startup", "artificial intelligence company", "AI solutions company", "AI consulting firm"),
    "ml": ("machine learning company", "ML startup", "machine learning consultancy"),
    "llm": ("large language model company", "generative AI company", "LLM startup"),
    "blockchain": ("blockchain company", "blockchain startup", "web3 company"),
    "devops": ("devops consulting company", "devops services company", "cloud devops firm"),
    "kubernetes": ("kubernetes consulting company", "cloud infrastructure company", "container orchestration company"),
    "aws": ("AWS cloud consulting company", "AWS managed services company"),
    "azure": ("Microsoft Azure consulting company", "Azure cloud services company"),
    "rpa": ("RPA company", "robotic process automation company", "RPA consulting firm"),
    "uipath": ("UiPath implementation company", "UiPath consulting partner", "RPA automation company"),
    "tableau": ("business intelligence company", "data visualization company", "analytics consulting firm"),
    "selenium": ("QA automation company", "software testing company", "test automation firm"),
}
INDUSTRY_EXPANSIONS = {
    "software": ("software development company", "IT services", "custom software company", "software engineering company", "SaaS company", "technology consulting", "digital transformation company"),
    "ai": ("AI startup", "AI company", "AI software", "ML company", "generative AI company"),
    "health": ("healthcare tech", "healthtech startup", "medical software company", "digital health company"),
    "manufacturing": ("manufacturing company", "industrial manufacturer", "production factory"),
    "fintech": ("fintech startup", "financial technology company", "financial software firm"),
    "ecommerce": ("e-commerce company", "digital commerce agency", "retail tech company"),
    "marketing": ("digital marketing agency", "SEO agency", "marketing firm", "creative agency"),
    "real estate": ("proptech startup", "real estate technology company", "real estate agency"),
    "logistics": ("logistics company", "supply chain tech", "freight forwarding company"),
    "education": ("edtech startup", "education technology company", "e-learning company"),
    "robotics": ("robotics company", "automation startup", "robotics engineering firm"),
    "legal": ("legaltech startup", "law firm", "legal services company"),
    "textile": ("textile manufacturing company", "apparel manufacturer"),
    "agriculture": ("agritech startup", "agricultural technology company", "farming solutions company"),
    "iot": ("IoT company", "internet of things startup", "connected devices company"),
    "gaming": ("game development studio", "gaming company", "esports company"),
    "insurance": ("insurtech startup", "insurance company", "insurance brokerage"),
}
ROLE_TEMPLATES = ("{keyword} company", "{keyword} companies", "{keyword} consulting firm", "{keyword} services")
TECHNOLOGY_TEMPLATES = ("{keyword} company", "{keyword} companies", "{keyword} software company", "{keyword} services company")
PRODUCT_TEMPLATES = ("{keyword} company", "{keyword} software company", "{keyword} solutions provider", "{keyword} vendor")
SERVICE_TEMPLATES = ("{keyword} company", "{keyword} agency", "{keyword} firm")
INDUSTRY_TEMPLATES = ("{keyword} companies", "{keyword} company", "{keyword} startups", "{keyword} solutions", "{keyword} agency")
#: Places that a keyword may end with.
LOCATIONS = ("noida", "gurugram", "gurgaon", "chandigarh", "delhi", "ncr", "mumbai", "bangalore", "bengaluru", "pune", "hyderabad", "chennai", "kolkata", "jaipur", "ahmedabad")
#: Search templates by source and priority.
SOURCE_TEMPLATES = (
    ("google", 100, ("{keyword} {location}", "best {keyword} {location}", "top {keyword} {location}")),
    ("linkedin", 90, ('site:linkedin.com/company "{keyword}"', 'site:linkedin.com/company "{keyword}" {location}')),
    ("clutch", 80, ('site:clutch.co "{keyword}" {location}', 'site:clutch.co "{keyword}"')),
    ("goodfirms", 70, ('site:goodfirms.co "{keyword}"', 'site:goodfirms.co "{keyword}" {location}')),
    ("github", 60, ('site:github.com "{keyword}" {location}',)),
)
#: Tasks planned for a keyword (source, query; {l} with a blank before it, or nothing).
EXACT_TASKS = (
    ("google", "{k}{l}"), ("google", "{k} company{l}"), ("google", "{k} services{l}"), ("google", "{k} solutions{l}"), ("google", "{k} consulting{l}"),
    ("brave", "{k} company{l}"), ("duckduckgo", "{k} services{l}"), ("bing", "{k} solutions{l}"), ("google", "intitle:{k}{l}"),
    ("linkedin", "site:linkedin.com/company {k}{l}"), ("clutch", "site:clutch.co {k}{l}"), ("goodfirms", "site:goodfirms.co {k}{l}"), ("github", "site:github.com {k} development{l}"),
)
CONCEPT_TASKS = (
    ("google", "{c} software companies{l}"), ("google", "{c} startups{l}"), ("google", "{c} company{l}"), ("google", "{c} software company{l}"), ("google", "{c} development company{l}"),
    ("brave", "{c} company{l}"), ("duckduckgo", "{c} software company{l}"), ("bing", "{c} development company{l}"),
)
FOCUS_TASKS = (
    ("google", "custom {c} development{l}"), ("brave", "{c} outsourcing{l}"), ("duckduckgo", "{c} consulting{l}"),
    ("google", "{c} services{l}"), ("brave", "enterprise {c} solutions{l}"), ("duckduckgo", "custom {c} solutions{l}"),
)
PROFILE_TASKS = (("linkedin", "site:linkedin.com/company {c}{l}"), ("clutch", "site:clutch.co {c}{l}"), ("goodfirms", "site:goodfirms.co {c}{l}"), ("github", "site:github.com {c} development{l}"))
#: Company queries of a variant {v} at a place {l}, and of sources.
B2B_QUERIES = ("{v} {l}", '"{v}" "{l}"', "top {v} in {l}", "{v} {l} website", "{v} {l} pvt ltd")
B2B_SOURCES = ("site:linkedin.com/company", "site:justdial.com", "site:indiamart.com")
B2B_SOURCE_QUERIES = ("{s} {v} {l}", '{s} "{l}" {v}')
B2B_LAST = ("{v} {l} -jobs -career -hiring", "{v} {l} -job -hiring")
B2C_QUERIES = ("{v} near {l}", "{v} {l} contact", "{v} {l} phone number", '"{v}" "{l}"')
B2C_SOURCES = ("site:justdial.com", "site:yellowpages.com", "site:sulekha.com")
#: Base weights of queries.
QUERY_WEIGHTS = {"source": 0.65, "quoted": 0.95, "generic": 1.0}

#: Company types and industries by words in a text, in order.
COMPANY_TYPES = {
    "AI Startup": ("artificial intelligence", "machine learning", "deep learning", "llm", "generative ai", "neural network", "nlp"),
    "Software Company": ("saas", "software", "platform", "cloud", "app", "application", "erp", "crm", "devops", "api"),
    "Consultancy": ("consulting", "consultancy", "advisory", "management consulting", "strategy consulting"),
    "Agency": ("agency", "creative agency", "marketing agency", "digital agency", "advertising agency"),
    "Manufacturer": ("manufacturer", "manufacturing", "production", "fabrication", "oem", "factory"),
    "Industrial": ("industrial", "automation", "robotics", "plc", "scada", "engineering", "heavy industry"),
    "Healthcare": ("healthcare", "hospital", "medical", "pharma", "pharmaceutical", "clinical", "biotech", "medtech"),
    "Finance": ("financial", "fintech", "banking", "insurance", "investment", "payment", "trading", "wealth"),
    "Marketplace": ("marketplace", "ecommerce", "e-commerce", "retail", "store", "shop", "b2b marketplace"),
    "Telecom": ("telecom", "telecommunications", "network", "connectivity", "broadband", "wireless"),
    "Construction": ("construction", "infrastructure", "civil", "real estate", "architecture", "contractor"),
    "Legal": ("law firm", "legal", "attorney", "solicitor", "compliance"),
    "Education Company": ("edtech", "e-learning", "lms", "learning management", "online education"),
}
INDUSTRIES = {
    "Artificial Intelligence": ("ai", "artificial intelligence", "machine learning", "deep learning", "llm", "generative", "neural network", "natural language processing", "computer vision"),
    "Industrial Automation": ("automation", "rpa", "robotic process", "industrial automation", "plc", "scada", "hmi", "dcs", "iot", "iiot"),
    "Mechanical Engineering": ("mechanical engineering", "mechanical", "hvac", "thermal", "fluid dynamics", "manufacturing engineering"),
    "Civil Engineering": ("civil engineering", "infrastructure", "structural", "construction", "geotechnical", "transportation"),
    "Software Development": ("software development", "app development", "web development", "devops", "agile", "full stack", "backend", "frontend"),
    "Cloud Computing": ("cloud", "aws", "azure", "gcp", "saas", "paas", "iaas", "kubernetes", "docker"),
    "Cybersecurity": ("cybersecurity", "security", "infosec", "soc", "penetration testing", "firewall", "compliance"),
    "Healthcare": ("healthcare", "medical", "pharma", "hospital", "clinical", "biotech", "medtech", "health tech"),
    "Finance": ("fintech", "banking", "financial services", "insurance", "investment", "payment processing"),
    "Electrical Engineering": ("electrical engineering", "power systems", "semiconductor", "electronics", "embedded systems"),
    "Chemical Engineering": ("chemical engineering", "process engineering", "petrochemical", "polymer", "refinery"),
    "Logistics": ("logistics", "supply chain", "shipping", "warehouse", "freight", "last mile"),
    "EdTech": ("edtech", "e-learning", "online learning", "lms", "education technology"),
}
#: Kinds of organisations by host endings and counted words.
ORGANISATION_WORDS = {
    "B2B Software": ("b2b", "enterprise", "saas", "software engineering", "solutions provider", "it services"),
    "B2C/Marketplace": ("shop", "store", "buy", "cart", "consumer", "ecommerce", "marketplace", "shipping", "retail"),
    "NGO": ("non-profit", "charity", "donation", "ngo", "association", "society"),
    "Education": ("syllabus", "course", "university", "college", "academy", "learn", "tutorial"),
    "Consultancy": ("consulting", "consultancy", "agency", "firm", "services firm"),
}
OPEN_SOURCE_TERMS = ("foundation", "non-profit", "community", "open source")
EDUCATION_HOSTS = ("college", "univ", "school")
#: Words that count as one root.
ROOTS = {
    "technology": "technolog", "technologies": "technolog", "tech": "technolog", "electronics": "electron", "electronic": "electron", "python": "python",
    "software": "softwar", "hardware": "hardwar", "developer": "develop", "development": "develop", "consulting": "consult", "consultancy": "consult",
    "automation": "automat", "automated": "automat",
}
#: Labels of concepts.
CONCEPTS = {
    "fast api": "FastAPI", "fastapi": "FastAPI", "fast-api": "FastAPI", "artificial intelligence": "AI", "artificial-intelligence": "AI", "machine learning": "ML", "machine-learning": "ML",
    "natural language processing": "NLP", "large language model": "LLM", "large language models": "LLM", "robotic process automation": "RPA",
    "industrial internet of things": "IIoT", "industrial iot": "IIoT", "iiot": "IIoT", "internet of things": "IoT", "iot": "IoT", "vector database": "Vector DB", "vector db": "Vector DB",
    "computer vision": "Computer Vision", "deep learning": "Deep Learning", "generative ai": "Generative AI", "open source": "Open Source", "k8s": "Kubernetes", "iac": "IaC", "oem": "OEM", "crm": "CRM",
}
#: Words left out when a keyword's domain is looked up.
DOMAIN_NOISE = ("noida", "delhi", "mumbai", "bangalore", "hyderabad", "chennai", "pune", "kolkata", "gurgaon", "india", "best", "top", "leading", "pvt", "ltd", "inc", "llc")

#: Hosts and paths of company profiles, signs of them elsewhere, and hosts of none.
PROFILE_PATHS = (("clutch.co", "/profile/"), ("goodfirms.co", "/company/"), ("linkedin.com", "/company/"), ("wellfound.com", "/company/"), ("crunchbase.com", "/organization/"), ("zoominfo.com", "/c/"), ("apollo.io", "/companies/"))
PROFILE_SIGNS = ("/company/", "/organization/", "/profile/", "/profiles/", "/business/", "/businesses/", "/c/")
NO_PROFILE_HOSTS = (
    "facebook.com", "twitter.com", "x.com", "instagram.com", "youtube.com", "play.google.com", "apps.apple.com", "chromewebstore.google.com",
    "wikipedia.org", "reddit.com", "medium.com", "github.com", "google.com", "apple.com", "microsoft.com",
)
DIRECTORY_LINKS = 50
#: Texts of links to a company's own site, and hosts that are none.
WEBSITE_LINKS = ("visit website", "website", "visit site", "website link", "go to website")
NO_WEBSITE_HOSTS = ("facebook.com", "twitter.com", "instagram.com", "youtube.com", "google.com", "apple.com")
#: What is looked for in a company's page.
ROLES = ("engineer", "developer", "founder", "ceo", "director", "manager", "team", "president", "architect", "programmer")
CERTIFICATIONS = ("iso 9001", "iso 27001", "hipaa", "soc 2", "gdpr", "pci-dss")
PARTNERS = ("aws partner", "microsoft partner", "google cloud partner", "salesforce partner")

#: Hosts that search results leave out.
NO_RESULT_HOSTS = ("google.com", "google.co.in", "google.co.uk", "googleadservices.com", "doubleclick.net", "youtube.com", "maps.google.com", "support.google.com", "accounts.google.com")
#: Kinds of recorded answers by terms in the page, in order: (kind, confidence, terms, terms of the url, status).
ANSWER_BLOCKS = (
    ("CAPTCHA_PAGE", 0.99, ("menlo.gutsenv.net", "safeview", "menlosecurity", "menlo security", "sv_role="), ("menlo.gutsenv.net",), None),
    ("CAPTCHA_PAGE", 0.99, ("g-recaptcha", "hcaptcha", "recaptcha", "i'm not a robot", "showcaptcha", "captcha-form", "security check"), (), None),
    ("SORRY_PAGE", 0.99, ("our systems have detected unusual traffic", "unusual traffic from your computer network", "sorry/index.html", "unusual traffic"), ("/sorry/",), 429),
    ("CONSENT_PAGE", 0.98, ("before you continue to google", "consent.google", "accept all", "cookie consent", "agree before you continue"), ("consent.google",), None),
    ("ENABLE_JS_PAGE", 0.95, ("/httpservice/retry/enablejs", "enablejs", "javascript required", "please click here", "enable javascript"), (), None),
    ("LOGIN_PAGE", 0.95, ("accounts.google.com/login", "sign in - google accounts", "log in to your account", "google login"), ("accounts.google",), None),
    ("ZERO_RESULTS_PAGE", 0.99, ("did not match any documents", "no results found for", "did not match any search results", "no organic results matched"), (), None),
)
ANSWER_SIGNS = (
    ("AI_OVERVIEW_PAGE", 0.90, ("ai overview", "generative ai", "google ai reference", "super-overview")),
    ("KNOWLEDGE_PANEL_PAGE", 0.90, ("knowledge panel", "kp-blk", "kno-vrt-g", "kp-header")),
    ("FEATURED_SNIPPET_PAGE", 0.85, ("featured snippet", 'class="c2xz6d"', 'class="kp-header"')),
    ("PEOPLE_ALSO_ASK_PAGE", 0.85, ("people also ask", "related-question-pair", 'class="yo340b"')),
)
ANSWER_LOCAL = ("google.co.", "google.com.")
#: Compared with pages in lower case, so those with capitals never occur.
ANSWER_ORGANIC = ('id="search"', 'class="g"', "/url?q=", 'class="r"', 'id="main"', 'class="v7w49e"', "data-hveid", 'class="tF2Cxc"', 'class="yuRUbf"', 'class="MjjYud"', 'class="N54PNb"')
#: Signs of another engine's answers.
BING_BLOCKS = (("MENLO_INTERCEPT", ("menlo.gutsenv.net", "safeview", "menlosecurity", "sv_role=")), ("BING_CAPTCHA", ("captcha", "security check", "please complete")))
BING_CONSENT = (("consent.bing.com", "/consent"), ("bnp_cookie_banner", "bnp_container", "/consent/accept"))
BING_NOTHING = ("no results found", "did not match any documents")
BING_LAYOUT = ("sb_form", "b_results")
#: Class of an outcome by the class of its error.
ERROR_OUTCOMES = {
    "captcha": "GOOGLE_CAPTCHA", "sorry_page": "GOOGLE_CAPTCHA", "enablejs": "GOOGLE_CAPTCHA", "consent_page": "GOOGLE_CAPTCHA", "rate_limit": "GOOGLE_429",
    "tls_failure": "TRANSPORT_TLS_ERROR", "certificate_failure": "TRANSPORT_TLS_ERROR", "timeout": "TRANSPORT_TIMEOUT", "dead_connection": "TRANSPORT_CONNECTION_ERROR",
}
#: Titles of articles, as the last stage knows them.
POLISH_TITLES = (
    r"^list of\b", r"^what is\b", r"^what are\b", r"^how to\b", r"^the .{0,40} of\b", r"^guide to\b", r"\bguide$", r"^top\s+\d*", r"^\d+\s+(top|best|different)",
    r"companies\s+in\b", r"companies\s+to\s+know", r"jobs\s+in\b", r"^popular\b", r"^best\b.*\(?\d{4}\)?$", r"largest\s+.{0,40}\s+by\b",
    r"^does\b", r"^is\b.*\?$", r"vs\s+human", r"^free\b.*writer", r"connects.*to\b", r"overview trends", r"current startups", r"^»", r":\s*meaning", r"assistant:.*meaning",
)
#: Columns that only help to find faults.
DEBUG_FIELDS = ("_flags", "_source_file", "_verified_emails", "_verified_phones", "_website_reachable", "_verification_notes", "_verification_passed", "_enrichment")
#: Further tasks for keywords of one domain.
HARDWARE_DOMAIN = "hardware_development"
HARDWARE_SOURCES = ("google", "duckduckgo", "bing", "brave")
HARDWARE_TASKS = ("electronics manufacturing company{l}", "PCB design company{l}", "embedded systems company{l}", "electronics design services{l}", "EMS company{l}", "electronic product development company{l}", "hardware design consultancy{l}")
#: Terms of paths that teach.
LEARNING_PATHS = ("what-is-", "what_is_", "tutorial", "course", "learn", "guide", "blog", "news", "article", "definition", "ranking", "admission", "fees", "placement", "college", "university")
#: Page kinds in order: kind, confidence, and what must hold: a part of the page
#: (url, host, path, listing: the path between slashes, title) and terms, one of which it holds.
PAGE_KINDS = (
    ("COMPANY_PROFILE", 0.98, (("host", ("linkedin.com", "facebook.com", "twitter.com", "x.com", "instagram.com", "youtube.com", "reddit.com", "pinterest.com")), ("url", ("linkedin.com/company",)))),
    ("SOCIAL", 0.99, (("host", ("linkedin.com", "facebook.com", "twitter.com", "x.com", "instagram.com", "youtube.com", "reddit.com", "pinterest.com")),)),
    ("COMPANY_PROFILE", 0.98, (("url", ("clutch.co/profile/", "goodfirms.co/company/", "crunchbase.com/organization/", "wellfound.com/company/", "zoominfo.com/c/", "apollo.io/companies/")),)),
    ("COMPANY_PROFILE", 0.95, (("url", ("github.com/",)), ("code_owner", ()))),
    ("DIRECTORY_LIST", 0.97, (("host", ("clutch.co", "goodfirms.co")), ("path", ("/search", "/companies", "/directory")))),
    ("DIRECTORY_LIST", 0.97, (("host", ("crunchbase.com",)), ("path", ("/discover/",)))),
    ("DIRECTORY_LIST", 0.95, (("listing", ("/search", "/search/", "/directory", "/directories", "/category", "/categories", "/best", "/top", "/profiles")),)),
    ("DIRECTORY_LIST", 0.92, (("title", ("top companies", "best companies", "top software", "best software", "directories", "directory list", "list of best")),)),
    ("MARKETPLACE", 0.99, (("host", ("play.google.com", "apps.apple.com", "chromewebstore.google.com")),)),
    ("MARKETPLACE", 0.95, (("host", ("amazon.com", "ebay.com")),)),
    ("JOB_POSTING", 0.95, (("host", ("indeed.com", "glassdoor.com")), ("job_list", ()))),
    ("CAREERS", 0.90, (("host", ("indeed.com", "glassdoor.com")),)),
    ("JOB_POSTING", 0.90, (("path", ("/job/", "/jobs/", "/careers/", "/join-us", "/careers-at/")), ("job_number", ()))),
    ("CAREERS", 0.95, (("path", ("/job/", "/jobs/", "/careers/", "/join-us", "/careers-at/")),)),
    ("DOCUMENTATION", 0.92, (("docs", ()),)),
    ("FORUM", 0.95, (("forum", ()),)),
    ("BLOG", 0.95, (("blog", ()),)),
    ("ARTICLE", 0.99, (("host", ("wikipedia.org",)),)),
    ("NEWS", 0.95, (("host", ("techcrunch.com", "forbes.com", "nytimes.com", "bloomberg.com", "reuters.com", "medium.com")),)),
    ("NEWS", 0.90, (("learning", ()), ("url", ("news", "press")))),
    ("BLOG", 0.90, (("learning", ()), ("url", ("blog",)))),
    ("ARTICLE", 0.90, (("learning", ()),)),
    ("COMPANY_HOMEPAGE", 0.90, (("own_root", ()),)),
)
PAGE_UNKNOWN = ("UNKNOWN", 0.40)
CODE_PAGES = ("features", "marketplace", "pricing", "trending", "explore", "topics", "collections", "login", "join", "search", "about")
ROOT_PATHS = ("", "/", "/index.html", "/index.php", "/home")
#: Other words that a term also stands for.
SYNONYMS = {
    "electronics": ("electrónica", "electrónico", "electrónicos"), "electronic": ("electrónica", "electrónico", "electrónicos"), "development": ("desarrollo", "desarrollador", "desarrolladores"),
    "developer": ("desarrollo", "desarrollador", "desarrolladores"), "engineering": ("ingeniería", "ingeniero", "ingenieros"), "engineer": ("ingeniería", "ingeniero", "ingenieros"), "design": ("diseño", "diseñador"),
    "services": ("servicios",), "company": ("compañía", "empresa", "empresas"), "software": ("software", "programa", "programación"), "hardware": ("hardware", "equipos"),
    "embedded systems": ("sistemas embebidos", "sistemas empotrados", "embebidos"), "automation": ("automatización", "control"), "robotics": ("robótica",), "custom software": ("software a medida", "desarrollo a medida"),
    "hardware development": ("desarrollo de hardware",), "software development": ("desarrollo de software", "desarrollo software"), "electronics manufacturing": ("fabricación electrónica", "fabricación de electrónica"),
    "electronics design": ("diseño electrónico", "diseño de electrónica"), "hardware design": ("diseño de hardware",),
}

#: E-mail addresses and telephone numbers as a homepage's score looks for them.
HOMEPAGE_EMAIL = r"[\w\.-]+@[\w\.-]+\.\w+"
HOMEPAGE_PHONE = r"\+?\d{1,3}[-.\s]?\(?\d{2,3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
#: Domains of social networks; words of footer links; words of links to pages of a site, by kind.
SOCIAL_DOMAINS = ("linkedin.com", "twitter.com", "x.com", "facebook.com", "instagram.com")
FOOTER_WORDS = ("contact", "about", "team", "support", "help", "info", "reach")
SUBPAGE_WORDS = {
    "contact_page": ("contact", "contact-us", "get-in-touch", "reach-us"),
    "about_page": ("about", "about-us", "company", "who-we-are"),
    "team_page": ("team", "our-team", "people", "leadership", "management", "founders", "executives", "board", "directors"),
    "careers_page": ("careers", "jobs", "join-us", "work-with-us"),
    "privacy_page": ("privacy", "privacy-policy", "privacy-policy", "data-protection"),
}
#: Words of a title, in order, and those written in capitals.
DESIGNATIONS = (
    "founder", "co-founder", "cofounder", "ceo", "cto", "coo", "cfo", "cmo", "director", "managing director", "president", "vice president", "vp",
    "head of", "partner", "managing partner", "chairman", "chairperson",
)
DESIGNATION_ACRONYMS = ("ceo", "cto", "coo", "cfo", "cmo", "vp", "md")
#: Length up to which a block can be a title, and words that the name before it may have.
TITLE_LENGTH, NAME_WORDS = 120, 5
