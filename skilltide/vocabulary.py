"""Vocabularies as data: skill spellings, role families, specializations."""

from __future__ import annotations

# Lower-case spelling -> canonical skill name.
CANONICAL_SKILLS = {
    # Frontend
    "react.js": "React", "reactjs": "React", "vue.js": "Vue", "vuejs": "Vue",
    "angularjs": "Angular", "angular.js": "Angular", "sveltejs": "Svelte",
    "next.js": "Next.js", "nuxt.js": "Nuxt.js",
    # Backend
    "express.js": "Express", "expressjs": "Express", "nestjs": "NestJS", "flask": "Flask",
    "django": "Django", "rails": "Ruby on Rails", "ror": "Ruby on Rails",
    "springboot": "Spring Boot", "spring boot": "Spring Boot",
    # Languages
    "js": "JavaScript", "javascript": "JavaScript", "ts": "TypeScript",
    "typescript": "TypeScript", "py": "Python", "csharp": "C#", "golang": "Go", "cpp": "C++",
    "c plus plus": "C++", "c plus-plus": "C++", "shell scripting": "Shell",
    "bash scripting": "Shell",
    # Databases
    "postgresql": "PostgreSQL", "postgre": "PostgreSQL", "mysql": "MySQL", "mariadb": "MySQL",
    "mongo": "MongoDB", "mongodb": "MongoDB", "dynamodb": "DynamoDB", "sqlite3": "SQLite",
    "redis": "Redis", "cassandra": "Cassandra", "elastic search": "Elasticsearch",
    "elasticsearch": "Elasticsearch",
    # Infrastructure
    "docker": "Docker", "k8s": "Kubernetes", "kubernetes": "Kubernetes",
    "terraform": "Terraform", "ansible": "Ansible", "jenkins": "Jenkins",
    "github actions": "GitHub Actions", "aws": "AWS", "gcp": "GCP", "google cloud": "GCP",
    "azure": "Azure", "heroku": "Heroku", "linux": "Linux",
    # Data and machine learning
    "pandas": "Pandas", "numpy": "NumPy", "scikit learn": "Scikit-learn",
    "sklearn": "Scikit-learn", "tensorflow": "TensorFlow", "keras": "Keras",
    "pytorch": "PyTorch", "matplotlib": "Matplotlib", "seaborn": "Seaborn",
    "jupyter notebook": "Jupyter", "jupyter": "Jupyter", "spark": "Apache Spark",
    "hadoop": "Hadoop",
    # Testing
    "jest": "Jest", "mocha": "Mocha", "pytest": "Pytest", "unittest": "unittest",
    "selenium": "Selenium", "cypress": "Cypress",
    # Tools
    "git": "Git", "jira": "Jira", "slack": "Slack", "figma": "Figma", "postman": "Postman",
    "vscode": "VSCode",
    # Other
    "graphql": "GraphQL", "rest api": "REST", "restful api": "REST", "soap": "SOAP",
    "ci/cd": "CI/CD", "tdd": "TDD", "oop": "OOP", "design patterns": "Design Patterns",
    "etl": "ETL", "data pipelines": "Data Pipelines",
}

# Lower-case technology name -> usual capitalization.
TECH_CAPITALIZATION = {
    "python": "Python", "java": "Java", "javascript": "JavaScript",
    "typescript": "TypeScript", "c": "C", "c++": "C++", "c#": "C#", "go": "Go",
    "golang": "Go", "rust": "Rust", "ruby": "Ruby", "php": "PHP", "swift": "Swift",
    "kotlin": "Kotlin", "scala": "Scala", "sql": "SQL", "mysql": "MySQL",
    "postgresql": "PostgreSQL", "postgres": "PostgreSQL", "sqlite": "SQLite",
    "mongodb": "MongoDB", "redis": "Redis", "cassandra": "Cassandra", "hbase": "HBase",
    "hdfs": "HDFS", "spark": "Spark", "hadoop": "Hadoop", "flink": "Flink",
    "airflow": "Airflow", "kafka": "Kafka", "zookeeper": "ZooKeeper", "docker": "Docker",
    "kubernetes": "Kubernetes", "terraform": "Terraform", "ansible": "Ansible",
    "jenkins": "Jenkins", "circleci": "CircleCI", "github actions": "GitHub Actions",
    "git": "Git", "github": "GitHub", "gitlab": "GitLab", "bitbucket": "Bitbucket",
    "react": "React", "react.js": "React", "vue": "Vue.js", "vue.js": "Vue.js",
    "angular": "Angular", "next.js": "Next.js", "nuxt.js": "Nuxt.js", "svelte": "Svelte",
    "tailwind": "Tailwind CSS", "bootstrap": "Bootstrap", "django": "Django",
    "flask": "Flask", "fastapi": "FastAPI", "express": "Express.js", "node": "Node.js",
    "node.js": "Node.js", "graphql": "GraphQL", "rest": "REST", "grpc": "gRPC",
    "html": "HTML", "css": "CSS", "sass": "Sass", "less": "Less", "pytorch": "PyTorch",
    "tensorflow": "TensorFlow", "keras": "Keras", "sklearn": "scikit-learn",
    "scikit-learn": "scikit-learn", "pandas": "pandas", "numpy": "NumPy",
    "matplotlib": "Matplotlib", "seaborn": "Seaborn", "openai": "OpenAI", "llama": "LLaMA",
    "t5": "T5", "bert": "BERT", "gpt": "GPT", "huggingface": "Hugging Face", "aws": "AWS",
    "amazon web services": "AWS", "azure": "Azure", "gcp": "GCP", "google cloud": "GCP",
    "firebase": "Firebase", "heroku": "Heroku", "netlify": "Netlify", "vercel": "Vercel",
    "linux": "Linux", "unix": "Unix", "macos": "macOS", "windows": "Windows", "bash": "Bash",
    "powershell": "PowerShell", "shell": "Shell", "vim": "Vim", "neovim": "Neovim",
    "vscode": "VS Code", "intellij": "IntelliJ", "eclipse": "Eclipse", "xcode": "Xcode",
    "android studio": "Android Studio", "jupyter": "Jupyter Notebook",
    "notebook": "Jupyter Notebook", "tableau": "Tableau", "powerbi": "Power BI",
    "excel": "Excel", "snowflake": "Snowflake", "bigquery": "BigQuery",
    "databricks": "Databricks", "looker": "Looker", "superset": "Apache Superset",
    "airbyte": "Airbyte", "dbt": "dbt", "mlflow": "MLflow", "kibana": "Kibana",
    "elasticsearch": "Elasticsearch", "prometheus": "Prometheus", "grafana": "Grafana",
}

# Seed role families.
SEED_FAMILIES = (
    "software engineer", "data scientist", "data engineer", "machine learning engineer",
    "devops engineer", "security engineer", "qa engineer", "site reliability engineer",
    "data analyst", "product manager", "hardware engineer", "solutions architect",
)

# Seed specializations.
SEED_SPECIALIZATIONS = (
    "backend", "frontend", "fullstack", "web", "mobile", "ios", "android", "embedded",
    "firmware", "platform", "infrastructure", "cloud", "distributed systems", "ml", "ai",
    "nlp", "computer vision", "llm", "gamedev", "graphics", "reliability", "networking",
    "payments", "search", "blockchain",
)
