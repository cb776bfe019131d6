"""Named queries over the supplied tables, each with its SQL where SQL can say it."""
