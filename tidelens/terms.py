"""Word lists, lookup tables and patterns that results depend on. All are defaults of parameters."""

TECH_TERMS = [
    "ai", "ml", "machine learning", "deep learning", "neural", "algorithm", "data science", "python", "javascript", "react", "vue", "angular", "tensorflow", "pytorch", "research", "paper", "study", "analysis", "blockchain", "crypto", "bitcoin", "ethereum", "quantum", "robotics",
    "automation", "startup", "funding", "ipo", "acquisition", "api", "cloud", "aws", "azure", "google", "microsoft", "apple", "meta", "tesla", "spacex", "open source", "github", "programming", "developer", "software", "hardware", "security", "privacy", "database", "web3",
]
TECH_PHRASES = [
    "open source", "machine learning", "deep learning", "artificial intelligence", "data science", "programming", "software development", "web development", "mobile development", "cloud computing", "cybersecurity", "blockchain", "cryptocurrency", "startup", "tech company", "api", "framework", "library", "algorithm", "database", "architecture", "devops",
]
POST_TERMS = [
    "ai", "ml", "machine learning", "deep learning", "neural network", "algorithm", "data science", "python", "tensorflow", "pytorch", "research", "paper", "study", "analysis", "model", "dataset", "blockchain", "crypto", "quantum", "robotics", "automation",
]
REPORT_TECH_TERMS = [
    "ai", "artificial intelligence", "machine learning", "ml", "deep learning", "neural network", "algorithm", "automation", "robotics", "quantum", "blockchain", "cryptocurrency", "cloud", "api", "software", "hardware", "data science", "analytics", "python", "javascript", "react", "tensorflow",
]
FILING_FORMS = {
    "10-K": "Annual Report", "10-Q": "Quarterly Report", "8-K": "Current Report", "10-K/A": "Annual Report Amendment", "10-Q/A": "Quarterly Report Amendment", "8-K/A": "Current Report Amendment", "DEF 14A": "Proxy Statement", "S-1": "Registration Statement", "S-3": "Registration Statement", "4": "Insider Trading Report", "3": "Initial Statement of Ownership", "5": "Annual Statement of Changes in Ownership",
}
FILING_CATEGORIES = {
    "10-K": ["annual_report", "financial_statement"], "10-K/A": ["annual_report", "financial_statement"], "10-Q": ["quarterly_report", "financial_statement"], "10-Q/A": ["quarterly_report", "financial_statement"], "8-K": ["current_report", "material_event"], "8-K/A": ["current_report", "material_event"], "DEF 14A": ["proxy_statement", "shareholder_communication"],
    "S-1": ["registration_statement", "securities_offering"], "S-3": ["registration_statement", "securities_offering"], "3": ["insider_trading", "ownership_change"], "4": ["insider_trading", "ownership_change"], "5": ["insider_trading", "ownership_change"],
}
FILING_IMPORTANCE = {"8-K": 9, "8-K/A": 9, "10-K": 8, "10-K/A": 8, "4": 8, "10-Q": 7, "10-Q/A": 7, "DEF 14A": 6, "S-1": 6, "S-3": 6, "3": 4, "5": 4}
FRAMEWORKS = {
    "react": ["react", "jsx"], "vue": ["vue", "vuejs"], "angular": ["angular", "ng"], "django": ["django"], "flask": ["flask"], "express": ["express", "expressjs"], "spring": ["spring", "springboot"], "rails": ["rails", "ruby-on-rails"], "laravel": ["laravel"], "tensorflow": ["tensorflow", "tf"], "pytorch": ["pytorch", "torch"],
    "scikit-learn": ["scikit-learn", "sklearn"], "pandas": ["pandas"], "numpy": ["numpy"], "docker": ["docker", "dockerfile", "containerization"], "kubernetes": ["kubernetes", "k8s"], "aws": ["aws", "amazon-web-services"], "azure": ["azure", "microsoft-azure"], "gcp": ["gcp", "google-cloud"],
}
KEYWORD_DOMAINS = [  # in order: domain, words looked for in the title, words looked for in the abstract
    ("quantum_computing", ["quantum"], ["quantum"]), ("artificial_intelligence", ["machine learning", "ai"], []), ("blockchain", ["blockchain", "crypto"], []), ("climate_science", ["climate", "environment"], []), ("biotechnology", ["bio", "medical"], []),
]
PAPER_DOMAINS = {
    "computer_vision": ["vision", "image", "visual", "cnn", "convolution", "detection", "segmentation", "recognition"],
    "nlp": ["language", "text", "linguistic", "nlp", "bert", "transformer", "tokeniz", "semantic"],
    "ml_theory": ["learning theory", "optimization", "convergence", "generalization", "statistical learning"],
    "reinforcement_learning": ["reinforcement", "rl", "agent", "environment", "reward", "policy", "q-learning"],
    "deep_learning": ["deep", "neural network", "backpropagation", "gradient descent", "activation"],
    "ai_safety": ["safety", "alignment", "robustness", "interpretability", "explainable", "fairness"],
    "robotics": ["robot", "manipulation", "locomotion", "control", "autonomous", "sensors"],
    "quantum_computing": ["quantum", "qubit", "entanglement", "superposition", "gate"],
    "bioinformatics": ["protein", "dna", "gene", "biological", "molecular", "genomic"],
    "healthcare_ai": ["medical", "clinical", "diagnosis", "healthcare", "patient", "disease"],
}
METHOD_FAMILIES = {
    "self_supervised": ["self-supervised", "unsupervised pre-training", "contrastive learning"],
    "attention_mechanisms": ["attention", "transformer", "self-attention"],
    "meta_learning": ["meta-learning", "few-shot", "learning to learn"],
    "adversarial_training": ["adversarial", "gan", "generative adversarial"],
    "transfer_learning": ["transfer", "fine-tuning", "pre-trained"],
    "multimodal_fusion": ["multimodal", "cross-modal", "fusion"],
}
APPLICATION_FAMILIES = {
    "healthcare": ["medical", "clinical", "healthcare", "diagnosis", "treatment"],
    "autonomous_systems": ["autonomous", "self-driving", "robotic", "navigation"],
    "edge_computing": ["edge", "mobile", "embedded", "iot", "resource-constrained"],
    "sustainability": ["sustainable", "energy-efficient", "green", "carbon", "environmental"],
    "human_ai_interaction": ["human-ai", "interaction", "collaborative", "interface", "usability"],
}
TECHNICAL_PATTERNS = [r"(\w+)\s+(network|architecture|algorithm|method|approach|technique)", r"(attention|transformer|convolution|recurrent|lstm|gru)", r"(\w+)\s+(learning|training|optimization)"]
ENTITY_PATTERNS = {
    "ALGORITHM": r"\b(?:algorithm|method|approach|technique|model)\s+(?:called|named|termed)?\s*([A-Z][A-Za-z0-9\-]+)",
    "DATASET": r"\b(?:dataset|corpus|benchmark)\s+(?:called|named)?\s*([A-Z][A-Za-z0-9\-]+)",
    "METRIC": r"\b([A-Z][A-Za-z0-9\-]+)\s+(?:score|metric|measure|accuracy|precision|recall|f1)",
    "METHOD": r"\b(?:propose|introduce|present)\s+(?:a|an|the)?\s*(?:new|novel)?\s*([A-Za-z0-9\-]+)",
}
NOVELTY_TERMS = ["novel", "new", "first", "introduces", "proposes", "breakthrough"]
NUMBER_PATTERNS = [r"\d+%", r"\d+x", r"\d+\.\d+", "times faster", "reduction"]
METHOD_WORDS = ["method", "approach", "algorithm", "technique", "architecture", "framework"]
BUSINESS_TERMS = ["cost", "market", "commercial", "application", "deployment", "scalable", "enterprise", "industry", "practical", "real-world", "production"]
IMPACT_TERMS = ["enables", "allows", "provides", "offers", "delivers", "impact", "benefit"]
TITLE_IMPLICATIONS = [
    ("embedding", "Improved text embeddings enable better search and recommendation systems"),
    ("productivity", "Developer productivity insights inform AI tool adoption strategies"),
    ("inference", "Better statistical methods reduce data collection costs"),
]
WEB_BOILERPLATE = "Cookie|Privacy Policy|Terms of Service|Subscribe|Newsletter"
WEB_NAVIGATION = "Home|About|Contact|Menu|Search"
#: Our choice: common English words left out of keywords.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves"
).split()
#: Our choice: a small lexicon (word, polarity, subjectivity); callers pass their own table.
LEXICON = [
    ("good", 0.7, 0.6), ("great", 0.8, 0.75), ("excellent", 1.0, 1.0), ("best", 1.0, 0.3), ("better", 0.5, 0.5), ("novel", 0.2, 0.4), ("effective", 0.6, 0.8), ("robust", 0.4, 0.6), ("bad", -0.7, 0.67), ("poor", -0.4, 0.6), ("worse", -0.4, 0.6), ("worst", -1.0, 1.0), ("wrong", -0.5, 0.9), ("difficult", -0.5, 1.0), ("limited", -0.07, 0.14),
    ("idiot", -0.8, 0.8), ("stupid", -0.8, 1.0), ("trash", -0.6, 0.7), ("loser", -0.5, 0.6), ("pathetic", -1.0, 1.0), ("disgusting", -1.0, 1.0), ("scum", -0.7, 0.8), ("moron", -0.8, 1.0),
]
