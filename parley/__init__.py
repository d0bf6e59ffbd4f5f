"""parley: customer-360 and conversation-quality analytics on PySpark."""
