"""daybook: import jobs, calendar-spine analytics and text ranking on Spark DataFrames."""
