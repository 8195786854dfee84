"""Themes of a text by the words that speak of them."""
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A theme and the strings any of which, in lower case anywhere in the text, speaks of it.
THEMES = {
    "Information Management": ("information", "data", "knowledge"),
    "Project Management": ("project", "task", "deadline"),
    "Problem Solving": ("problem", "solution", "issue"),
    "Learning & Development": ("learn", "study", "research"),
    "Communication": ("meeting", "discussion", "communication"),
    "Technology": ("software", "system", "technology"),
    "Development": ("develop", "build", "create"),
    "Analysis": ("analyze", "evaluate", "assess"),
    "Planning": ("plan", "strategy", "design"),
    "Implementation": ("implement", "execute", "deploy"),
    "Optimization": ("optimize", "improve", "enhance"),
    "Artificial Intelligence": ("ai", "machine learning", "neural"),
    "Database Management": ("database", "sql", "query"),
    "Security": ("security", "encryption", "authentication"),
    "Performance": ("performance", "optimization", "efficiency"),
    "Software Architecture": ("architecture", "design pattern", "framework"),
    "Scheduling": ("schedule", "timeline", "deadline"),
    "Historical Analysis": ("history", "past", "previous"),
    "Future Planning": ("future", "upcoming", "next"),
    "Team Collaboration": ("team", "collaboration", "group"),
    "Process Management": ("process", "workflow", "procedure"),
    "Quality Assurance": ("quality", "testing", "validation"),
    "Documentation": ("document", "specification", "manual"),
}


def themes(text: Column) -> Column:
    """array<string>: the themes a text speaks of, in the order above."""
    found = lambda low: F.array_compact(F.array(*(F.when(reduce(or_, (F.contains(low, F.lit(w)) for w in words)), name) for name, words in THEMES.items())))
    # bound by transform, a text is lowered once, not once a word; of a theme's words the first that is found is enough
    return F.transform(F.array(F.lower(text)), found)[0]
