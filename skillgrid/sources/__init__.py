"""Reading landed data into postings and texts, and keeping the stored tables."""
