"""confab: conversation-transcript analytics as Spark DataFrame operators."""
