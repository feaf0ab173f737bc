"""alertframe.functions"""
