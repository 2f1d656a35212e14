"""trialstats: repeated-measures analytics over trial and questionnaire logs, on Spark DataFrames."""
